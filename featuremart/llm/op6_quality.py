"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-
leader (FTRL-proximal) updates and scored as a sparse dot product.

Features of a text are the one- and two-word n-grams of its lower-cased tokens (runs of word bytes,
runs of punctuation) and the one- to three-token n-grams of token shapes (kind, letter case, length
class, whether the token repeats the one before), all hashed into ``2**bits`` weights. A feature's
value is its share of the text's n-grams of that family, so a text of any length is scored over all
of its tokens.

Training reads a bounded, documented sample: the ``max_rows`` labelled training rows with the least
hash of their id. Scoring covers every row and uses nothing but the text.

Defined cases: null and empty texts (no tokens) get the model's bias as score; labels that are null
are ignored; different labels of one id count as several rows, documents that repeat an id as the one
with the least text; ids may be of any type; long texts are read in pieces that end where a token does,
which changes no feature; without any labelled row every score is
the prior 0.5. Extra columns are ignored, names may clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import U64, crc_mod, map_batches, mix, prefix_hash, read_table, ship, span_hash

MAX_ROWS = 8000      # bound of the training sample
BITS = 18            # 2**BITS hashed weights (2 MB as doubles): what a model broadcasts
PASSES = 4           # passes over the sample
VALUE_SCALE = 12.0   # family shares are multiplied by this before the dot product
PART = 1 << 20       # bytes of a text whose token arrays are held at once

# Token classes of the 256 byte values: 0 space, 1 punctuation, 2 word (letters, digits, non-ASCII).
_CLASS = np.full(256, 1, dtype=np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1


def _tokens(raw: bytes):
    """(hashes, shapes) arrays of the text's tokens, of about ``PART`` bytes at a time. Pieces end where a
    token does, so a token that is longer than a piece makes its piece longer."""
    at = 0
    while at < len(raw):
        size = PART
        while True:
            end = min(len(raw), at + size)
            kind = _CLASS[np.frombuffer(raw[at:end], dtype=np.uint8)]
            edge = np.flatnonzero(np.diff(kind)) + 1
            if end == len(raw) or len(edge):
                break
            size *= 2
        if end < len(raw):
            end, kind = at + int(edge[-1]), kind[:edge[-1]]
        data = np.frombuffer(raw[at:end], dtype=np.uint8)
        edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
        at = end
        start, stop = edge[:-1], edge[1:]
        real = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
        start, stop = start[real], stop[real]
        if not len(start):
            continue
        caps = np.concatenate(([0], np.cumsum(_UPPER[data])))
        n_caps, size = caps[stop] - caps[start], stop - start
        case = np.where(n_caps == 0, 0, np.where((n_caps == size) & (size > 1), 2, 1))
        shape = (kind[start].astype(U64) * U64(3) + case.astype(U64)) * U64(4) + np.minimum(size // 4, 3).astype(U64)
        yield span_hash(prefix_hash(_LOWER[data]), start, stop), shape


def features(text: str | None, bits: int = BITS) -> list[np.ndarray]:
    """Two families of hashed n-gram positions: words and shapes, over the whole text."""
    words, shapes = [], []
    made = list(_tokens((text or "").encode("utf-8", "surrogatepass")))
    if made:
        h, shape = (np.concatenate(x) for x in zip(*made))
        same = np.concatenate(([False], h[1:] == h[:-1]))
        s = mix((shape * U64(2) + same.astype(U64)) + U64(1))
        words.append(h)
        if len(h) > 1:
            words.append(mix(h[:-1] * U64(3) + h[1:]))
        for n in range(1, 4):
            if len(s) >= n:
                acc = np.full(len(s) - n + 1, n, dtype=U64)
                for i in range(n):
                    acc = mix(acc * U64(5) + s[i:len(s) - n + 1 + i])
                shapes.append(acc)
    shift = U64(64 - bits)
    return [(np.concatenate(f) >> shift).astype(np.int64) if f else np.zeros(0, dtype=np.int64)
            for f in (words, shapes)]


@dataclass
class Model:
    """``bias`` and hashed ``weights``; ``score`` is the logistic of a sparse dot product."""

    bias: float
    weights: np.ndarray
    bits: int = BITS

    def score(self, text: str | None) -> float:
        z = self.bias
        for f in features(text, self.bits):
            if len(f):
                z += VALUE_SCALE * float(self.weights[f].mean(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, z)))))


def ftrl(rows: list[tuple[str | None, int]], bits: int = BITS, passes: int = PASSES, alpha: float = 0.3,
         beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """Per-coordinate FTRL-proximal over ``rows`` in the given order; the last slot is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    made = []
    for text, y in rows:
        idx, val = [np.array([size - 1])], [np.ones(1)]
        for f in features(text, bits):
            if len(f):
                u, c = np.unique(f, return_counts=True)
                idx.append(u)
                val.append(VALUE_SCALE * c / len(f))
        i, v = np.concatenate(idx), np.concatenate(val)
        u, inv = np.unique(i, return_inverse=True)
        made.append((u, np.bincount(inv, weights=v), float(y)))
    for _ in range(passes):
        for i, v, y in made:
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, float(w @ v)))))
            g = (p - y) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    return float(w[-1]), w[:-1]


def train(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows whose ``train_rows(id column name)`` holds.

    Only (id, label) pairs are sampled; the sampled ids, bounded by ``max_rows``, are then joined to
    the texts, and one task that holds at most ``max_rows`` texts makes the sequential updates.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(train_rows("id"))
              .distinct().orderBy(F.xxhash64("id"), "id", "y").limit(max_rows))
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
              .groupBy("id", "y").agg(F.min("t").alias("t"))  # a repeated id is one row
              .select(F.xxhash64(F.lit(1), "id").alias("h"), "y", "t"))

    def fit(batches):
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        rows.sort(key=lambda r: (r[0], r[1], r[2] or ""))  # the order of the updates must not follow the ids
        if not rows:
            return
        bias, w = ftrl([(t, y) for _, y, t in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))],
                                         names=["i", "w"])

    got = sample.repartition(1).mapInArrow(fit, "i long, w double").toArrow()  # at most 2**BITS + 1 rows
    model = Model(0.0, np.zeros(1 << BITS))
    for i, w in zip(got.column("i").to_pylist(), got.column("w").to_pylist()):
        if i < 0:
            model.bias = w
        else:
            model.weights[i] = w
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's (doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        m = shared.value
        return ids, [m.score(t) for t in texts]

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                       f"doc_id {kind}, score double")


def passing(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at)
            keep = pa.array([shared.value.score(texts[i].as_py()) >= least for i in range(b.num_rows)],
                            type=pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)


#: The query's folds: rows with this remainder are held out.
MOD, HELD = 4, 2
THRESHOLD = 0.7


def train_fold(id_col: str):
    return crc_mod(id_col, MOD) != HELD


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels, train_fold)
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", MOD) == HELD, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
