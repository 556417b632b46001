"""Language ID with bit-sliced n-gram filters.

One Bloom filter per language, stored bit-sliced: row ``i`` of the table is a bitmask over all
languages, so the AND of a few rows gives *all* languages that contain an n-gram at once. A text is
decided by per-language popcounts over its n-grams, corrected for each filter's false positives:
``c = (hits - n f) / (1 - f)`` with ``f`` the share of set bits of the language's slice to the power
of the probes.

Learning reads a bounded, documented sample: per language the ``per_lang`` training rows with the
least hash of their id. A language holds an n-gram if it is at least ``min_count`` times in its
sample and its rate there is at least ``share`` of the highest rate in any language. Prediction
covers every whole text and uses nothing but the text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text with letters
and no known n-gram gets the language with most sampled rows and score 0; ties go to the language
that sorts first; null languages are not learned; without any learned language every row is
``und``. Any number of languages (one 64-bit word of mask per 64). Texts of any length give the n-grams
of the whole text. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featuremart.llm.common import U64, crc_mod, map_batches, mix, read_table, ship

PER_LANG = 1000     # bound of the sample: rows per language
SLOT_BITS = 20      # 2**SLOT_BITS filter rows: 8 MB of masks per 64 languages
PROBES = 3
SIZES = (3, 4)      # bytes of an n-gram
MIN_COUNT = 2
SHARE = 0.3
PART = 1 << 20      # bytes of a text whose n-grams are held at once

# Bytes that are no part of a word become spaces: all of ASCII but the letters.
_WORD = np.full(256, 32, dtype=np.uint8)
_WORD[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str | None):
    """64-bit hashes of the n-grams of the lower-cased text, words separated by one space. Long texts are
    read ``PART`` bytes at a time; the last bytes of a part are carried over, so no n-gram is lost or made."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    tail, after_space = np.full(1, 32, dtype=np.uint8), True
    for at in range(0, len(raw), PART):
        data = _WORD[np.frombuffer(raw[at:at + PART], dtype=np.uint8)]
        space = data == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] |= not after_space
        after_space = bool(space[-1])
        end = [np.full(1, 32, dtype=np.uint8)] if at + PART >= len(raw) else []
        data = np.concatenate([tail, data[keep], *end])
        wide = data.astype(U64)
        for n in SIZES:
            new = wide[max(0, len(tail) - n + 1):]  # the n-grams that end in this part
            if len(new) >= n:
                acc = np.full(len(new) - n + 1, n, dtype=U64)
                for i in range(n):
                    acc = (acc << U64(8)) | new[i:len(new) - n + 1 + i]
                yield mix(acc)
        tail = data[-(max(SIZES) - 1):]


@dataclass
class Model:
    """``table``: (rows, words) masks; ``fp``: false-positive rate of each language's slice."""

    langs: list[str]
    table: np.ndarray
    prior: list[int] = field(default_factory=list)
    fp: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.langs:
            ones = np.array([(self.table[:, i // 64] >> U64(i % 64) & U64(1)).mean() for i in range(len(self.langs))])
            self.fp = ones ** PROBES

    def masks(self, g: np.ndarray) -> np.ndarray:
        """(n-grams, words): all languages that contain each n-gram."""
        out = None
        for row in slots(g):
            got = self.table[row]
            out = got if out is None else out & got
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        n, hits = 0, np.zeros(len(self.langs))
        for g in grams(text):
            n += len(g)
            m = self.masks(g)
            for i in range(len(self.langs)):  # popcount of a bit slice
                hits[i] += np.count_nonzero(m[:, i // 64] & U64(1 << (i % 64)))
        c = np.clip((hits - n * self.fp) / np.maximum(1.0 - self.fp, 1e-9), 0.0, None)
        if c.sum() <= 0:
            return self.langs[int(np.argmax(self.prior))], 0.0
        best = int(np.argmax(c))
        return self.langs[best], float(c[best] / c.sum())


def slots(g: np.ndarray) -> list[np.ndarray]:
    """The filter rows of n-gram hashes: disjoint bit ranges of the hash."""
    return [(g >> U64(SLOT_BITS * j) & U64((1 << SLOT_BITS) - 1)).astype(np.int64) for j in range(PROBES)]


def train(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = PER_LANG) -> Model:
    """Sample, count n-grams per language, build the bit-sliced filter as one grouped OR per row.

    What reaches the driver is the list of languages and the table (at most ``2**SLOT_BITS`` rows)."""
    ship(docs.sparkSession)
    rows = (docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
            .where(F.col("id").isNotNull() & F.col("lang").isNotNull()).where(train_rows("id")))
    # Only rows whose hash is low enough to be among the least can be sampled: per language about
    # 4 * per_lang rows reach the ranking, however many there are.
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Model([], np.zeros((1 << SLOT_BITS, 1), dtype=U64))
    reach = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, 4 * per_lang / n))])
    low = (F.xxhash64("id") / float(1 << 64) + 0.5) <= reach[F.col("lang")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = rows.where(low).withColumn("r", rank).where(F.col("r") <= per_lang).select("id", "lang")
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    index = {lang: i for i, lang in enumerate(langs)}
    sample = (docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                          F.col(text_col).alias("t"))
              .join(F.broadcast(ids), ["id", "lang"]).select("lang", "t"))  # per_lang rows a language

    def count(batches):
        for b in batches:
            per: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                per.setdefault(index[lang], []).extend(grams(text))
            for i, parts in per.items():
                if parts:
                    g, c = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), pa.array(np.full(len(g), i, dtype=np.int32)),
                         pa.array(c.astype(np.int64))], names=["g", "l", "c"])

    counted = sample.mapInArrow(count, "g long, l int, c long").groupBy("g", "l").agg(F.sum("c").alias("c"))
    totals = counted.groupBy("l").agg(F.sum("c").alias("total"))  # a row a language
    rated = counted.join(F.broadcast(totals), "l").withColumn("p", F.col("c") / F.col("total"))
    top = rated.groupBy("g").agg(F.max("p").alias("top"),
                                 F.collect_list(F.struct("l", "c", "p")).alias("has"))  # a row a language each
    held = (top.select("g", "top", F.explode("has").alias("h"))
            .where((F.col("h.c") >= MIN_COUNT) & (F.col("h.p") >= SHARE * F.col("top"))))
    words = -(-len(langs) // 64)
    bits = held.select(
        F.explode(F.array(*[F.shiftrightunsigned("g", SLOT_BITS * j).bitwiseAND((1 << SLOT_BITS) - 1)
                            for j in range(PROBES)])).alias("row"), F.col("h.l").alias("l"))
    one = [F.bit_or(F.when(F.floor(F.col("l") / 64) == w, F.expr("shiftleft(1L, l % 64)")).otherwise(F.lit(0)))
           .alias(f"w{w}") for w in range(words)]
    got = bits.groupBy("row").agg(*one).toArrow()
    table = np.zeros((1 << SLOT_BITS, words), dtype=U64)
    at = got.column("row").to_numpy()
    for w in range(words):
        table[at, w] = got.column(f"w{w}").to_numpy().astype(np.int64).view(U64)
    return Model(langs, table, [sizes[x] for x in langs])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's (doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        got = [shared.value.predict(t) for t in texts]
        return ids, [x for x, _ in got], [s for _, s in got]

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                       f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a language with score ``least`` or more."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(text: str | None) -> bool:
        lang, s = shared.value.predict(text)
        return lang != "und" and s >= least

    def run(batches):
        for b in batches:
            texts = b.column(at)
            yield b.filter(pa.array([keep(texts[i].as_py()) for i in range(b.num_rows)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: The query's folds: rows with this remainder are held out.
MOD, HELD = 5, 0


def train_fold(id_col: str):
    return crc_mod(id_col, MOD) != HELD


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, train_fold)
    return predict(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", MOD) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
