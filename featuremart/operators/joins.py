"""Join helpers.

Broadcasting is decided by an explicit row count of the small side: a side within the bound is
hinted ``broadcast`` (no shuffle of the large side); beyond it the join stays a shuffled join and
AQE may still convert or split it at runtime from real sizes, and a bit table of the keys cuts the
large side to about its matches before it is shuffled.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuremart.shared import stage

MAX_BYTES = 64 << 20  # text size of a broadcast side

_SIZED: "weakref.WeakKeyDictionary[DataFrame, tuple[int, DataFrame]]" = weakref.WeakKeyDictionary()


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if ``df`` has at most ``max_rows`` rows, else ``df`` unchanged.

    The check is one distributed count of rows and bytes (pruned to the columns the caller selected;
    no rows move), bounded by ``max_rows`` and ``MAX_BYTES``; its outcome is remembered for the same DataFrame.
    """
    if max_rows <= 0:
        return df
    hit = _SIZED.get(df)
    if hit is not None and hit[0] == max_rows:
        return hit[1]
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    out = F.broadcast(df) if n <= max_rows and size <= MAX_BYTES else df
    _SIZED[df] = (max_rows, out)
    return out


def restrict_to(df: DataFrame, keys: DataFrame, on: str, key_col: str | None = None) -> DataFrame:
    """Keep the rows of ``df`` whose ``on`` value occurs in ``keys`` (LEFT SEMI join, J1-J4).

    A semi join never multiplies rows, so repeated keys in the product list are harmless.
    ``keys`` should come from ``bounded_broadcast`` when it can be small.
    """
    key_col = key_col or on
    k = keys.select(F.col(key_col).alias("__k"))
    return df.join(k, F.col(on) == F.col("__k"), "left_semi")


LEAST_BITS, MOST_BITS = 16, 26  # of a key table, as powers of two: 1,048,576 words of 64 bits at most


def key_bits(keys: DataFrame, col: str) -> DataFrame:
    """A bit table of the keys, (w, m): word number and 64 bits, two bits set a key and about 16 bits room for each, at most
    ``2 ** MOST_BITS`` bits whatever the number of keys. Written once, so that it is made once for all facts."""
    n = keys.select(col).distinct().count()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * n - 1).bit_length() if n else 0))
    k = keys.where(F.col(col).isNotNull()).select(F.explode(F.array(*_places(col, size))).alias("p"))
    words = k.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("m"))
    return stage(words.withColumn("size", F.lit(size).cast("long")), "key-bits")


def _places(col: str, size: int) -> list[Column]:
    h = F.xxhash64(F.col(col).cast("string"))
    return [h.bitwiseAND(F.lit(size - 1).cast("long")), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1).cast("long"))]


def reduce_by_bits(df: DataFrame, on: str, bits: DataFrame, size: int) -> DataFrame:
    """The rows of ``df`` whose ``on`` may be a key of the bit table: all that are, and about one in 70 of the others while
    the table has its room. The table is broadcast (its size is bounded), so the rows that go are never shuffled."""
    known = df.columns
    for i, place in enumerate(_places(on, size)):
        word = F.broadcast(bits.select(F.col("w").alias(f"__w{i}"), F.col("m").alias(f"__m{i}")))
        df = df.join(word, F.shiftright(place, 6) == F.col(f"__w{i}"), "inner")
        bit = F.call_function("shiftrightunsigned", F.col(f"__m{i}"), (place % 64).cast("int"))
        df = df.where(bit.bitwiseAND(F.lit(1).cast("long")) == 1)
    return df.select(*known)


def not_placeholder(*cols: str) -> Column:
    """``c != '-' AND c != ''`` for every column; NULL fails as in SQL three-valued logic."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) != "-") & (F.col(c) != "")
    return cond
