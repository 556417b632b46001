"""Variable-capacity best-fit packing.

Pieces of documents go, longest first, into the open bin with the least room that still holds them;
if none does, a bin of the least-cost size is opened. Several permitted sequence lengths are
optimised jointly: a shard is packed once under every opening policy (the greedy least unit cost,
and each single length as the largest that may be opened), bins are finally downsized to the least
length that holds their contents, and the cheapest plan wins. A sequence of length ``c`` costs ``c``
plus a fixed overhead plus a quadratic share (attention), see ``cost``.

Plan: lengths, not texts, are packed. A document longer than the largest length is cut into pieces of
that length (nothing is dropped). Pieces are dealt to shards by a hash of their id; the number of
shards follows the row count, so a shard has about ``SHARD_ROWS`` pieces however large the corpus
is; a very long document only adds full pieces, which get bins of their own before any shard is
formed. Results do not depend on the partitioning.

Defined cases: null and empty texts have length 0: they take no room and get one row with no bin
(bin_id null); repeated ids are packed as rows of their own; null ids are allowed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import materialize, read_table, ship, sorted_groups

LENGTHS = (512, 1024, 2048, 4096)   # permitted sequence lengths
SHARD_ROWS = 20_000                 # pieces packed together
OVERHEAD, QUADRATIC = 16.0, 1 / 16384


def cost(c: int) -> float:
    """What one sequence of length ``c`` costs."""
    return c + OVERHEAD + QUADRATIC * c * c


def word_length(text: str = "text") -> Column:
    """Words of the whole text plus one separator; 0 for null and blank texts."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"))
    return F.when(n > 0, n + 1).otherwise(F.lit(0)).cast("long")


def downsize(used: int, lengths: tuple[int, ...]) -> int:
    return lengths[bisect_left(lengths, used)]


def best_fit(sizes: list[int], lengths: tuple[int, ...], largest: int | None = None) -> tuple[list[int], list[int]]:
    """Bin of every piece (sizes must not rise) and contents of every bin. ``largest``: the length
    that is opened (the least one that holds the piece, if that is more); None: least unit cost."""
    rest = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        rest[i] = rest[i + 1] + sizes[i]
    room_of: dict[int, list[int]] = defaultdict(list)  # room -> bins
    rooms: list[int] = []                              # sorted rooms in use
    bins, used = [], []
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = room_of[room].pop()
            if not room_of[room]:
                del rooms[at]
        else:
            b = len(used)
            used.append(0)
            fits = lengths[bisect_left(lengths, size):]
            if largest is not None:
                room = next((c for c in fits if c >= largest), fits[-1]) if fits[0] < largest else fits[0]
            else:  # a bin is filled as far as what is left can fill it
                room = min(fits, key=lambda c: (cost(c) / min(c, rest[i]), c))
        bins.append(b)
        used[b] += size
        room -= size
        if room:
            if not room_of[room]:
                insort(rooms, room)
            room_of[room].append(b)
    return bins, used


def plan(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of all opening policies: bin of every piece, contents and final length of bins."""
    best = None
    for policy in (None, *lengths):
        bins, used = best_fit(sizes, lengths, policy)
        final = [downsize(u, lengths) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, bins, used, final)
    return best[1:]


SCHEMA = "doc_id {id}, piece int, n_tokens long, start long, bin_id string, bin_length int, bin_used int, bin_offset int"


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None,
         lengths: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``n_tokens`` of the piece from token ``start`` of its document, its bin, the
    bin's final length and contents, and the piece's offset in it."""
    ship(docs.sparkSession)
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    kind = dict(docs.dtypes)[id_col]
    n = (length if length is not None else word_length()).alias("n")
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), n), "lengths")  # texts are measured once
    # Equal (id, length) rows are told apart by a running number below, never by their place in a file.
    rows = sized.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies")).select(
        "doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    whole = F.floor(F.col("n") / top).cast("long")
    full = rows.where(F.col("n") >= top).select(
        "doc_id", "copy", "n", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), F.lit(top).cast("long").alias("n_tokens"),
        (F.col("piece") * top).alias("start"),
        F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.col("n").cast("string"),
                    F.col("copy").cast("string"), F.col("piece").cast("string")).alias("bin_id"),
        F.lit(top).alias("bin_length"), F.lit(top).alias("bin_used"), F.lit(0).alias("bin_offset"))
    part = rows.where((F.col("n") % top > 0)).select(
        "doc_id", "copy", whole.cast("int").alias("piece"), (F.col("n") % top).cast("int").alias("size"),
        (whole * top).alias("start"))
    empty = rows.where("n = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("start"),
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"),
        F.lit(None).cast("int").alias("bin_used"), F.lit(None).cast("int").alias("bin_offset"))
    shards = max(1, -(-sized.count() // shard_rows))
    dealt = (part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "start"), F.lit(shards)).cast("int"))
             .select("shard", "size", "doc_id", "copy", "piece", "start")
             .repartition("shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "copy"))

    def run(batches):
        for (shard,), parts in sorted_groups(batches, 1):
            table = pa.Table.from_batches(parts)
            sizes = table.column("size").to_pylist()
            bins, used, final = plan(sizes, lengths)
            offsets, at = [], [0] * len(used)
            for b, s in zip(bins, sizes):
                offsets.append(at[b])
                at[b] += s
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("piece").combine_chunks(),
                 pa.array(sizes, pa.int64()), table.column("start").combine_chunks(),
                 pa.array([f"s{shard}-{b}" for b in bins]), pa.array([final[b] for b in bins], pa.int32()),
                 pa.array([used[b] for b in bins], pa.int32()), pa.array(offsets, pa.int32())],
                names=["doc_id", "piece", "n_tokens", "start", "bin_id", "bin_length", "bin_used", "bin_offset"])

    packed = dealt.mapInArrow(run, SCHEMA.format(id=kind))
    return packed.unionByName(full).unionByName(empty)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
