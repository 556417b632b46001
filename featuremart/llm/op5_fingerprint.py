"""Homomorphic multiset fingerprints of documents.

A fingerprint is the lane-wise sum, modulo powers of two, of wide vectors hashed from paragraphs
(lines): ``EXACT`` lanes of 64 bits of dense pseudo-random numbers, which decide equality, and
``SKETCH`` lanes of 32 bits, a signed count sketch of the paragraph's features, which estimate
likeness (a text has fewer than 2^31 bytes, so no lane of a text wraps). Sums commute, so paragraphs may
come in any order, and a paragraph is inserted or deleted by adding or subtracting its vector alone
(``insert``, ``delete``).

Features: a word (a run without white space or control bytes) is its windows of ``WINDOW`` bytes, a
shorter word is one window; a word's first window counts together with the window before it in its
paragraph, every further one alone. So words of usual length count as word pairs, and text without
spaces as overlapping strings.

Likeness of two fingerprints is 1 if they are equal, else the cosine of the sketch lanes read as
signed numbers, within [0, 1].

Plan of the query: texts are shuffled once, into blocks of neighbouring ids whose bounds come from a
bounded quantile sketch; each block also gets the one row that follows it. A streaming pass over the
sorted blocks holds two texts at a time.

Defined cases: null texts are empty; an empty text has the sum of no paragraphs (zero) and is like
another empty one by 1 and any other by 0, as are different texts of white space alone; empty lines are
paragraphs too; ids may be of any type that sorts (text ids in code-point order); null ids sort last
(descending), ties by text; repeated rows are neighbours of each other; one row is its own next
document. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import U64, mix, prefix_hash, read_table, ship, span_hash

EXACT = 8       # lanes modulo 2^64
SKETCH = 256    # lanes modulo 2^32
WINDOW = 16     # bytes of a feature's string
BLOCKS = 16384  # most blocks of neighbouring ids; their bounds are a literal of the plan
BLOCK_ROWS = 1000
_LANES = mix(np.arange(1, EXACT + 1, dtype=U64))


class Fingerprint:
    """Vector sums of paragraphs."""

    __slots__ = ("exact", "sketch")

    def __init__(self) -> None:
        self.exact = np.zeros(EXACT, dtype=U64)
        self.sketch = np.zeros(SKETCH, dtype=np.int64)

    def add(self, text: str, sign: int = 1) -> "Fingerprint":
        """Insert (or delete) every paragraph of ``text``."""
        exact, sketch = vectors(text)
        if sign > 0:
            self.exact, self.sketch = self.exact + exact, self.sketch + sketch
        else:
            self.exact, self.sketch = self.exact - exact, self.sketch - sketch
        return self

    def insert(self, paragraph: str) -> "Fingerprint":
        return self.add(paragraph)

    def delete(self, paragraph: str) -> "Fingerprint":
        return self.add(paragraph, -1)

    def hex(self) -> str:
        return (self.exact.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).hex()

    def likeness(self, other: "Fingerprint") -> float:
        a, b = self.sketch.astype(np.int32).astype(np.float64), other.sketch.astype(np.int32).astype(np.float64)
        if np.array_equal(self.exact, other.exact) and np.array_equal(a, b):
            return 1.0
        n = float(np.sqrt((a @ a) * (b @ b)))
        return 0.0 if n == 0 else float(min(1.0, max(0.0, (a @ b) / n)))


def vectors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the vectors of all paragraphs (lines) of ``text``; no paragraph in an empty text."""
    if not text:
        return np.zeros(EXACT, dtype=U64), np.zeros(SKETCH, dtype=np.int64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    p = prefix_hash(data)
    cut = np.flatnonzero(data == 10)
    start, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(data)]))
    h = span_hash(p, start, end)
    exact = mix(h[:, None] ^ _LANES).sum(axis=0, dtype=U64)
    gap = np.concatenate(([True], data <= 32, [True]))
    edge = np.flatnonzero(np.diff(gap.astype(np.int8)))
    ws, we = edge[0::2], edge[1::2]
    if not len(ws):
        return exact, np.zeros(SKETCH, dtype=np.int64)
    many = np.maximum(we - ws - WINDOW, 0) + 1  # windows of every word
    first = np.cumsum(many) - many
    start = np.repeat(ws - first, many) + np.arange(many.sum())
    w = span_hash(p, start, np.minimum(start + WINDOW, np.repeat(we, many)))
    before = np.zeros(len(w), dtype=U64)  # pairs do not cross paragraphs
    line = np.searchsorted(cut, ws)
    follows = np.flatnonzero(line[1:] == line[:-1]) + 1
    before[first[follows]] = w[first[follows] - 1]
    f = mix(before * U64(3) + w)
    lane, sign = (f >> U64(56)).astype(np.int64) % SKETCH, (f & U64(1)).astype(np.int64) * 2 - 1
    return exact, np.bincount(lane, weights=sign, minlength=SKETCH).astype(np.int64)


def fingerprint(text: str | None) -> Fingerprint:
    return Fingerprint().add(text or "")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = ("doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint, that of its edited text, and the likenesses to it and to the next row
    in descending id (after the last: the first)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if whole else F.col(id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = rows.select("key")
    n = keys.count()
    if not n:
        return docs.sparkSession.createDataFrame([], SCHEMA.format(id=kind))
    blocks = max(1, min(BLOCKS, n // BLOCK_ROWS))
    # any fixed bounds give right results, so a sketch of the quantiles or a sample of keys will do
    if blocks == 1:
        bounds = []
    elif whole:
        bounds = sorted({int(b) for b in keys.approxQuantile("key", [i / blocks for i in range(1, blocks)],
                                                             0.25 / blocks)})
    else:
        some = keys.where("key IS NOT NULL").distinct().orderBy(F.xxhash64("key"), "key").limit(blocks - 1)
        bounds = [r["key"] for r in some.orderBy("key").collect()]
    rows = rows.withColumn("block", block_of(bounds, F.col("key")))
    # the row that follows a block is the first of the next lower block that has rows: its greatest key
    tops = {r["block"]: r["m"] for r in rows.groupBy("block").agg(F.max("key").alias("m")).collect()}
    order = sorted(tops)
    serves = [(order[(i + 1) % len(order)], tops[b]) for i, b in enumerate(order)]  # (block above, key)
    after = docs.sparkSession.createDataFrame(serves, f"to int, after {'long' if whole else kind}")  # a row a block
    # of several rows with that key the first in text order follows
    extra = (rows.select("doc_id", "key", "text").join(F.broadcast(after), F.col("key").eqNullSafe(F.col("after")))
             .groupBy("to", "key").agg(F.min(F.struct("text", "doc_id")).alias("s"))
             .select("s.doc_id", "key", "s.text", F.col("to").alias("block")))
    dealt = (rows.select("block", F.lit(0).alias("extra"), "key", "text", "doc_id")
             .unionByName(extra.select("block", F.lit(1).alias("extra"), "key", "text", "doc_id"))
             .repartition("block").sortWithinPartitions("block", "extra", F.desc("key"), "text"))

    def run(batches):
        held = None
        for batch in batches:
            out = []
            ids, blk, ext, txt = (batch.column(i) for i in (4, 0, 1, 3))
            for i in range(batch.num_rows):
                text = txt[i].as_py()
                now = (blk[i].as_py(), ids[i].as_py(), text, fingerprint(text))
                if held is not None and held[0] == now[0]:
                    out.append(_row(held, now))
                held = None if ext[i].as_py() else now
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), [batch.schema.field(4).type, *_TYPES])],
                    names=_NAMES)

    return dealt.mapInArrow(run, SCHEMA.format(id=kind))


def block_of(bounds: list, key: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, found in two steps of about the square
    root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    many = F.lit(len(parts))

    def upto(a: Column) -> Column:
        return F.size(F.filter(a, lambda b: b <= key))

    coarse = F.greatest(upto(F.lit([p[0] for p in parts])), F.lit(1))
    return ((F.least(coarse, many) - 1) * step + upto(F.element_at(F.lit(parts), coarse))).cast("int")


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(now: tuple, following: tuple) -> tuple:
    _, doc, text, fp = now
    other = edited(text, following[2])
    fe = fingerprint(other)
    return (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), fp.hex(), fe.hex(),
            fp.likeness(fe), fp.likeness(following[3]))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
