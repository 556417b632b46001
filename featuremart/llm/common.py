"""Shared helpers: rolling hashes, Arrow row mapping, durable intermediate tables, components.

Intermediate tables are written as Parquet under the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor therefore never loses one, and plans that are reread from
them have no lineage behind them.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
ARROW_ROWS = 512  # rows of an Arrow batch
BLOOM_BITS = 1 << 23


# -- tables ------------------------------------------------------------------------------------

def ship(spark: SparkSession) -> None:
    """Make the session ready for tasks on whole texts.

    Arrow batches of Spark's default of 10,000 rows are whole texts here, so a session that has left it
    at that gets ``ARROW_ROWS``. Then send this package to the executors once per context, unless the submitter has put an archive on
    their path: tasks import it there, wherever the driver was started."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(ARROW_ROWS))
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(sc, "_training_data_shipped", False) or not os.path.isdir(root):
        return
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "training_data.zip")
    with open(path, "wb") as f:  # Spark's driver serves it to the executors
        f.write(made.getvalue())
    sc.addPyFile(path)
    sc._training_data_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session without the setting gets a
    folder of its own; on a cluster a missing setting is an error, as executors share no disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="fm-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[list[list]], dict | list], schema: str, rows: int = 128) -> DataFrame:
    """``mapInArrow`` in slices of ``rows`` input rows, so that a task holds the working arrays of a
    few texts at a time. ``fn`` gets one Python list per input column and returns the output columns
    as lists in the order of ``schema``."""
    ship(df.sparkSession)
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cols = fn(*[c.to_pylist() for c in part.columns])
                out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, target)],
                                                 schema=target)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


def bloom_split(df: DataFrame, marks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows that may have their ``key`` (a 64-bit hash) in ``marks``, and the rest,
    which surely do not. The Bloom filter is a table of at most ``BLOOM_BITS / 64`` words, whatever the
    number of rows, and is broadcast as such; a full filter sends every row to the first part."""
    def place(shift: int) -> Column:
        return F.shiftrightunsigned(key, shift).bitwiseAND(BLOOM_BITS - 1)

    words = (marks.select(F.explode(F.array(place(0), place(31))).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("m")))
    words = materialize(words, "bloom")
    known = df.columns
    found = F.lit(True)
    for i, shift in enumerate((0, 31)):
        w, m = f"__w{i}", f"__m{i}"
        df = df.join(F.broadcast(words.select(F.col("w").alias(w), F.col("m").alias(m))),
                     F.shiftright(place(shift), 6) == F.col(w), "left")
        found = found & (F.call_function("shiftrightunsigned", F.coalesce(F.col(m), F.lit(0).cast("long")),
                                         (place(shift) % 64).cast("int")).bitwiseAND(1) == 1)
    return df.where(found).select(*known), df.where(~found).select(*known)


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups of a stream sorted by its first ``n_keys`` columns, as lists of record-batch slices."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
        start = 0
        for i in range(n):
            if i == start and (not held or keys[i] != key):
                if held:
                    yield key, held
                    held = []
                key = keys[i]
            elif keys[i] != key:
                held.append(batch.slice(start, i - start))
                yield key, held
                held, key, start = [], keys[i], i
        held.append(batch.slice(start))
    if held:
        yield key, held


def text_key(col: str | Column) -> list[Column]:
    """128 bits that identify a text (null counts as empty): two independent 64-bit hashes."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(7), c, F.length(c)).alias("k2")]


def crc_mod(col: str, mod: int) -> Column:
    """``crc32(text of col) mod m``: the fixed split of rows into folds."""
    return F.crc32(F.col(col).cast("string")) % mod


# -- rolling hashes ----------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    def __init__(self) -> None:
        self.pow = np.ones(1, dtype=U64)
        self.inv = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) < n:
            size = max(n, 2 * len(self.pow), 1 << 14)
            for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
                a = np.full(size, base, dtype=U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.pow[:n], self.inv[:n]


_POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of ``(byte + 1) * BASE^i`` modulo 2^64, with a leading 0."""
    p, _ = _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the byte spans [start, end)."""
    _, inv = _POWERS.upto(len(prefix))
    h = (prefix[end] - prefix[start]) * inv[start]
    return mix(h + (np.asarray(end) - np.asarray(start)).astype(U64) * U64(0xD6E8FEB86659FD93))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values (block prefix and suffix minima, linear time)."""
    n = len(x)
    if w <= 1 or n == 0:
        return x.copy()
    if n <= w:
        return x.min(keepdims=True)
    top = np.iinfo(x.dtype).max
    blocks = -(-n // w)
    padded = np.full(blocks * w, top, dtype=x.dtype)
    padded[:n] = x
    b = padded.reshape(blocks, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# -- union-find inside a task ------------------------------------------------------------------

def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with edges (a[i], b[i]) on n nodes: at most n - 1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


# -- buckets of a similarity join ----------------------------------------------------------------

GROUP = ["path", "bi", "bj"]


def deal_blocks(leaves: DataFrame, block: int) -> DataFrame:
    """Rows (path, n, k1, k2) of buckets with n members -> (path, bi, bj, blk, k1, k2): a bucket of more
    than two blocks is dealt as pairs of blocks, each a group of its own; smaller ones stay whole."""
    blocks = F.greatest(F.lit(1), F.ceil(F.when(F.col("n") > 2 * block, F.col("n")).otherwise(0) / block)).cast("int")
    blk = F.pmod(F.xxhash64("k1", "k2"), blocks).cast("int")
    return (leaves.withColumn("blk", blk)
            .select("path", "blk", "k1", "k2", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
            .select("path", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "k1", "k2"))


def fresh_pairs(path: int, leaves: list[list[int]], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which pairs (rows[i], cols[i]) of a bucket's members share no bucket before ``path``; ``leaves``:
    all buckets of each member. So a pair counts in the first bucket alone, without moving pairs."""
    earlier = [{p for p in x if p < path} for x in leaves]
    return np.array([earlier[i].isdisjoint(earlier[j]) for i, j in zip(rows.tolist(), cols.tolist())], dtype=bool)


def fresh_matrix(path: int, leaves: list[list[int]]) -> np.ndarray:
    """The same for all pairs of a block."""
    before = [[p for p in x if p < path] for x in leaves]
    who = np.repeat(np.arange(len(leaves)), [len(x) for x in before])
    _, at, n = np.unique(np.array([p for x in before for p in x], dtype=np.int64), return_inverse=True,
                         return_counts=True)
    use = n[at] > 1  # a bucket that only one of them is in joins no pair
    m = np.zeros((len(leaves), max(1, int((n > 1).sum()))), dtype=np.float32)
    m[who[use], (np.cumsum(n > 1) - 1)[at[use]]] = 1
    return (m @ m.T) == 0


# -- connected components ----------------------------------------------------------------------

def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (struct or plain columns): rows (node, root) with
    ``root`` the least node, for every node of an edge.

    Alternating large-star / small-star rounds (min-label contraction): every round is one grouped
    minimum with partial aggregation and one join, so a hub with very many neighbours is a counter,
    not a collected list. Each round is written to the shared folder; it ends when an edge set
    repeats (a star forest), after O(log^2 n) rounds.
    """
    e = materialize(edges.where(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        # a set's fingerprint: count and an order-free checksum
        r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], r[1]

    before = mark(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        # large-star: neighbours above a node move to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = (e.join(least, F.col("v") == F.col("n"))
                 .select("u", F.col("m").alias("v")))  # u > v: u hangs below the least around v
        # small-star: a node and its lower neighbours hang below the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = (large.join(low, F.col("u") == F.col("n"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))))
        e = materialize(small.distinct(), "star")
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
