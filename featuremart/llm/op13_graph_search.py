"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Different vectors are dealt by hash to shards of about ``SHARD`` vectors. A shard's graph has levels: every vector is on
level 0, one in ``DEGREE`` of those on each next level. Each level links a vector to near and mutually diverse
vectors of that level. A search walks greedily from the top level's first vector to the level below, and on
level 0 with a list of the ``BEAM`` nearest found. The index is a table with one row per vector, its links as flat arrays
of places in its shard; every query searches every shard, and its results are merged by exact scores.

Largest inner products become nearest points by one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm, which
is 0 on unit vectors. So that long vectors don't make short ones meet in one point, vectors are parted by length (bands of
a factor of 8, each with its own M and shards). Graphs compare single-precision points; the candidates that a search
ends with are scored anew in double precision on the original vectors.

Plan. Equal vectors are one class, so a hot vector is one point of a graph; of its rows only the ``K + 1`` least
ids can be in a list of K, so only these travel. A shard is built by one task in batches: a batch searches the graph before
it as one matrix and links to what it finds and to itself. Queries travel to each shard in groups of ``GROUP`` and are
searched in blocks; a shard gives K rows a query, and a query's best K of all shards are ranked by a
window that limits them in each task before the shuffle. Memory of a task: one shard and one block.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as query
nor as candidate; a query's candidates are the vectors of its dimension; rows with a null id are candidates, after
all ids on ties, and no queries; repeated ids and rows are rows of their own, each a query whose only excluded row is
itself; a score beyond double precision is infinite,
and lowest if not even its sign is known. Labels and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featuremart.llm.common import U64, materialize, mix, read_table, ship, sorted_groups

K = 20
EVERY = 20      # of the ids, those it divides are queries
SHARD = 4096    # vectors of a shard, about
DEGREE = 16     # links of a new vector, and of a vector on an upper level; twice as many on level 0
BEAM = 96       # nearest found that a search keeps
BATCH = 256     # vectors linked, and queries searched, at a time
GROUP = 8192    # queries that a shard answers in one task
MOST_TASKS = 1 << 14


# -- graphs ------------------------------------------------------------------------------------------

def far(points: np.ndarray, a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances (rows, columns) of each row of ``a`` to its points ``at``; infinite where -1."""
    d = points[at] - a[:, None, :]
    return np.where(at < 0, np.float32(np.inf), np.einsum("ijk,ijk->ij", d, d))


def descend(points: np.ndarray, links: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The greedy walk of each row of ``a`` on one level, from its point ``start``."""
    at = start.copy()
    here = far(points, a, at[:, None])[:, 0]
    moving = np.arange(len(a))
    while len(moving):
        near = links[at[moving]]
        d = far(points, a[moving], near)
        best = d.argmin(axis=1)
        found = d[np.arange(len(moving)), best]
        on = found < here[moving]
        moving, near, best = moving[on], near[on], best[on]
        at[moving], here[moving] = near[np.arange(len(moving)), best], found[on]
    return at


def beam(points: np.ndarray, links: np.ndarray, a: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) nearest points found from ``start``, nearest first, with their distances; -1 where fewer."""
    n, rows = len(points), np.arange(len(a))
    found = np.full((len(a), width), -1, dtype=np.int64)
    dist = np.full((len(a), width), np.inf, dtype=np.float32)
    done = np.ones((len(a), width), dtype=bool)
    seen = np.zeros((len(a), n + 1), dtype=bool)  # the last column takes the places without a link
    found[:, 0], dist[:, 0], done[:, 0] = start, far(points, a, start[:, None])[:, 0], False
    seen[rows, start] = True
    open_ = rows
    while len(open_):
        nearest = np.where(done[open_], np.float32(np.inf), dist[open_]).argmin(axis=1)
        is_open = ~done[open_, nearest]
        open_, nearest = open_[is_open], nearest[is_open]
        if not len(open_):
            break
        done[open_, nearest] = True
        near = links[found[open_, nearest]]
        near = np.where(seen[open_[:, None], near], -1, near)
        seen[open_[:, None], near] = True
        d = far(points, a[open_], near)
        keep = d < dist[open_, -1][:, None]
        some = keep.any(axis=1)
        at = open_[some]
        if len(at):
            near, d = np.where(keep, near, -1)[some], np.where(keep, d, np.float32(np.inf))[some]
            all_d = np.concatenate([dist[at], d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist[at] = np.take_along_axis(all_d, order, axis=1)
            found[at] = np.take_along_axis(np.concatenate([found[at], near], axis=1), order, axis=1)
            done[at] = np.take_along_axis(np.concatenate([done[at], near < 0], axis=1), order, axis=1)
    return found, dist


def diverse(points: np.ndarray, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's points ``found`` (nearest first): those nearer to the row than to a point taken
    before, then the nearest of the rest."""
    rows, width = found.shape
    p = points[found]
    size = np.einsum("ijk,ijk->ij", p, p)
    between = size[:, :, None] + size[:, None, :] - 2 * (p @ p.transpose(0, 2, 1))
    nearest = np.full((rows, width), np.inf, dtype=np.float32)  # of the points taken
    taken = np.zeros((rows, width), dtype=bool)
    n = np.zeros(rows, dtype=np.int64)
    for j in range(width):
        take = (found[:, j] >= 0) & (n < most) & (dist[:, j] < nearest[:, j])
        taken[:, j] = take
        n += take
        nearest[take] = np.minimum(nearest[take], between[take, j])
    rank = np.where(taken, 0, np.where(found >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, dtype=np.int64)
    out[:, :order.shape[1]] = np.take_along_axis(found, order, axis=1)
    return out


def _join_back(points: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Links back to the points ``new`` from those they link to; a full point keeps diverse ones of all."""
    most = links.shape[1]
    to, of = links[new].ravel(), np.repeat(new, most)
    of, to = of[to >= 0], to[to >= 0]
    order = np.lexsort((((points[of] - points[to]) ** 2).sum(axis=1), to))
    of, to = of[order], to[order]
    targets, first, n = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, n)
    back = np.full((len(targets), most), -1, dtype=np.int64)
    near = place < most  # of many new links the nearest are weighed
    back[np.repeat(np.arange(len(targets)), n)[near], place[near]] = of[near]
    for at in range(0, len(targets), BATCH):
        target, more = targets[at:at + BATCH], back[at:at + BATCH]
        old = links[target]
        more[(more[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        both = np.concatenate([old, more], axis=1)
        d = far(points, points[target], both)
        order = np.argsort(d, axis=1, kind="stable")
        both, d = np.take_along_axis(both, order, axis=1), np.take_along_axis(d, order, axis=1)
        fits = (both >= 0).sum(axis=1) <= most
        links[target[fits]] = both[fits][:, :most]
        links[target[~fits]] = diverse(points, both[~fits], d[~fits], most)


def build(points: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Links per level of points in descending order of ``levels``: (points on the level, links) each."""
    graph: list[np.ndarray] = []
    for level in range(int(levels[0]), -1, -1):
        n = int((levels >= level).sum())
        most = DEGREE if level else 2 * DEGREE
        links = np.full((n, most), -1, dtype=np.int64)
        at = 1
        while at < n:
            new = np.arange(at, min(n, at + min(BATCH, at)))  # a batch is no larger than the graph before it
            a = points[new]
            start = np.zeros(len(new), dtype=np.int64)
            for upper in reversed(graph):
                start = descend(points, upper, a, start)
            start = np.where(start < at, start, 0)
            found, dist = beam(points[:at], links, a, start, BEAM)
            among = (a * a).sum(axis=1)[:, None] + (a * a).sum(axis=1) - 2 * (a @ a.T)
            np.fill_diagonal(among, np.inf)
            near = np.argsort(among, axis=1, kind="stable")[:, :min(len(new) - 1, 2 * DEGREE)]
            found = np.concatenate([found, new[near]], axis=1)
            dist = np.concatenate([dist, np.take_along_axis(among, near, axis=1).astype(np.float32)], axis=1)
            order = np.argsort(dist, axis=1, kind="stable")
            links[new, :DEGREE] = diverse(points, np.take_along_axis(found, order, axis=1),
                                          np.take_along_axis(dist, order, axis=1), DEGREE)
            _join_back(points, links, new)
            at = int(new[-1]) + 1
        graph.insert(0, links)
    return graph


def search(points: np.ndarray, graph: list[np.ndarray], a: np.ndarray, width: int) -> np.ndarray:
    start = np.zeros(len(a), dtype=np.int64)
    for links in reversed(graph[1:]):
        start = descend(points, links, a, start)
    return beam(points, graph[0], a, start, width)[0]


def level_of(keys: np.ndarray) -> np.ndarray:
    """Levels by hash: one in ``DEGREE`` points of a level is on the next one."""
    share = (mix(keys.view(U64)) >> U64(11)).astype(np.float64) / 2.0 ** 53
    return np.floor(-np.log(1 - share) / np.log(DEGREE)).astype(np.int64)


def lifted(vectors: np.ndarray, norm: float | None) -> np.ndarray:
    """Points in single precision, scaled to the largest norm; ``None``: queries, whose length doesn't matter."""
    top = np.abs(vectors).max(axis=1)
    size = top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))
    if norm is None:
        return np.concatenate([vectors / size[:, None], np.zeros((len(vectors), 1))], axis=1).astype(np.float32)
    more = np.sqrt(np.maximum(0, 1 - (size / norm) ** 2))
    more[more < 1e-3] = 0  # rounding of unit vectors
    return np.concatenate([vectors / norm, more[:, None]], axis=1).astype(np.float32)


# -- Spark -------------------------------------------------------------------------------------------

def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


SHARDED = ["dim", "band", "shard"]
INDEX = "dim int, band int, shard int, norm double, k1 long, k2 long, vector array<double>, level int, links array<int>"


def _arrays(shard: tuple, norm: float, n: int) -> list[pa.Array]:
    return [*[pa.array([x] * n, type=pa.int32()) for x in shard], pa.array([norm] * n, type=pa.float64())]


def index(dealt: DataFrame, tasks: int) -> DataFrame:
    """One row per vector of ``dealt`` (dim, band, shard, norm, k1, k2, vector): its place is its order by (level
    descending, k1, k2) in its shard; ``links`` are the places it links to on level 0, then on the levels above, -1 for none."""
    dealt = (dealt.select(*SHARDED, "norm", "k1", "k2", "vector")
             .repartition(tasks, *SHARDED)  # few rows, much work: not for AQE to merge
             .sortWithinPartitions(*SHARDED, "k1", "k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in sorted_groups(batches, 3):
            t = pa.Table.from_batches(parts)
            vectors, norm = _matrix(t.column("vector")), t.column("norm")[0].as_py()
            k1, k2 = (t.column(c).to_numpy() for c in ("k1", "k2"))
            levels = level_of(k2)
            order = np.lexsort((k2, k1, -levels))
            points = lifted(vectors[order], norm)
            graph = build(points, levels[order])
            n = len(order)
            for at in range(0, n, 1024):
                links = [np.concatenate([g[i] for g in graph if i < len(g)]) for i in range(at, min(n, at + 1024))]
                part = order[at:at + 1024]
                size = len(part)
                yield pa.RecordBatch.from_arrays(
                    [*_arrays(key, norm, size), pa.array(k1[part]), pa.array(k2[part]), pa.array(list(vectors[part]), type=pa.list_(pa.float64())),
                     pa.array(levels[part].astype(np.int32)),
                     pa.array([x.astype(np.int32) for x in links], type=pa.list_(pa.int32()))],
                    names=[c.split()[0] for c in INDEX.split(", ")])

    return dealt.mapInArrow(run, INDEX)


def _graph(levels: np.ndarray, links: list[np.ndarray]) -> list[np.ndarray]:
    """Links per level from the rows' flat arrays."""
    out = []
    for level in range(int(levels.max()) + 1):
        start, size = (2 * DEGREE + (level - 1) * DEGREE, DEGREE) if level else (0, 2 * DEGREE)
        out.append(np.array([x[start:start + size] for x, l in zip(links, levels) if l >= level], dtype=np.int64))
    return out


def _answers(rows: DataFrame, k: int) -> DataFrame:
    """Rows sorted by (dim, band, shard, part): a shard's vectors, then queries -> (query, k1, k2, score), the ``k`` best of
    every query in the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = vectors = points = graph = k1 = k2 = None

        def answered(t: pa.RecordBatch) -> pa.RecordBatch:
            a = _matrix(t.column("vector"))
            found = search(points, graph, lifted(a, None), max(BEAM, k))
            score = np.zeros(found.shape)
            with np.errstate(over="ignore", invalid="ignore"):
                for j in range(a.shape[1]):  # in the order of the components, as a plain sum
                    score = score + vectors[:, j][found] * a[:, j][:, None]
            score = np.where((found < 0) | np.isnan(score), -np.inf, score)
            order = np.argsort(-score, axis=1, kind="stable")
            best, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
            # equal scores at the end are all kept: ids decide later
            last = score[:, min(k, score.shape[1]) - 1]
            i, j = np.nonzero((best >= 0) & (score >= last[:, None]))
            return pa.RecordBatch.from_arrays(
                [pa.array(t.column("row").to_numpy(zero_copy_only=False)[i]), pa.array(k1[best[i, j]]), pa.array(k2[best[i, j]]),
                 pa.array(score[i, j])], names=["query", "k1", "k2", "score"])

        for (*shard, is_query), parts in sorted_groups(batches, 5):
            if not is_query:
                t = pa.Table.from_batches(parts)
                key, vectors = shard, _matrix(t.column("vector"))
                k1, k2 = (t.column(c).to_numpy() for c in ("k1", "k2"))
                levels = t.column("level").to_numpy()
                flat = t.column("links").combine_chunks()
                at, values = flat.offsets.to_numpy(), flat.values.to_numpy()
                graph = _graph(levels, [values[a:b] for a, b in zip(at[:-1], at[1:])])
                points = lifted(vectors, t.column("norm")[0].as_py())
            elif key == shard:
                for t in parts:
                    for at in range(0, t.num_rows, BATCH):
                        yield answered(t.slice(at, BATCH))

    return rows.mapInArrow(run, "query long, k1 long, k2 long, score double")


def neighbours(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
               shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the ``k`` nearest rows found."""
    ship(rows.sparkSession)
    v = F.col("vector")
    number = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = v.isNotNull() & (F.size(v) > 0) & number & F.exists(v, lambda x: x != 0)
    named = materialize(
        rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .where(F.coalesce(valid, F.lit(False)))
        .select("vec_id", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("k1"),
                F.xxhash64(F.lit(7), "vector").alias("k2"), F.monotonically_increasing_id().alias("row"),
                F.array_max(F.transform("vector", F.abs)).alias("top")), "vectors")
    classes = materialize(named.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.first("dim").alias("dim"),
                                                        F.max("top").alias("top")), "classes")
    top = F.col("top")
    length = top * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))
    sized = classes.withColumn("length", length).withColumn("band", F.round(F.log2("length") / 3).cast("int"))
    bands = materialize(sized.groupBy("dim", "band").agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"), F.max("length").alias("norm")), "bands")
    shards = bands.agg(F.sum("shards")).first()[0] or 0
    tasks = max(1, min(2 * shards, MOST_TASKS))
    dealt = sized.join(bands, ["dim", "band"]).withColumn("shard", F.pmod("k1", F.col("shards")).cast("int"))
    built = materialize(index(dealt, tasks), "graph")

    queries = named.where((F.col("vec_id") % every) == 0)
    groups = max(1, -(-queries.count() // GROUP))
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    none = {"level": F.lit(None).cast("int"), "links": F.lit(None).cast("array<int>"), "norm": F.lit(None).cast("double")}
    cols = [*SHARDED, "part", "is_query", "level_up", "norm", "k1", "k2", "row", "vector", "level", "links"]
    asked = queries.join(bands.drop("norm"), "dim").withColumns(
        {"part": part, "is_query": F.lit(True), **none, "level_up": F.lit(0)}).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*cols)
    held = built.withColumns({"is_query": F.lit(False), "row": F.lit(None).cast("long"), "level_up": -F.col("level")}).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*cols)
    sent = (held.unionByName(asked).repartition(min(tasks * groups, MOST_TASKS), *SHARDED, "part")
            .sortWithinPartitions(*SHARDED, "part", "is_query", "level_up", "k1", "k2", "row")
            .select(*SHARDED, "part", "is_query", "norm", "k1", "k2", "row", "vector", "level", "links"))
    found = _answers(sent, k + 1)
    # the k + 1 best classes of a query, then their rows: the least k + 1 ids of each
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc())
    best = materialize(found.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= k + 1)
                       .select("query", "k1", "k2", "score"), "found")
    by_id = Window.partitionBy("k1", "k2").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    least = (named.select("k1", "k2", "vec_id", "row").withColumn("place", F.row_number().over(by_id))
             .where(F.col("place") <= k + 1).drop("place"))
    listed = best.join(least, ["k1", "k2"]).where("row <> query")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (ranked.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
            .select("query_id", "rank", "vec_id", "score"))


def op13_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "embeddings"))
