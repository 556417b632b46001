"""N-gram Jaccard join by chosen paths.

Documents whose sets of five-word shingles have Jaccard similarity ``threshold`` or more are linked.
Sets are split recursively on sampled shared tokens: a token of the embedded set is (coordinate,
minimum hash of the shingles under it); a node of the path tree samples coordinates that its path has
not used and sends every set to the children named by its tokens there, ``ROOT`` of them at a root and
``PICK`` below. Sets less alike than 1 / ``PICK`` = ``ALIKE`` thus share fewer nodes with every level,
and a node whose sets are more alike than that on average is not split: it is judged before, from a
sample of its sets, and compared whole. Buckets of at most ``SMALL`` sets are compared by brute force.

The tree is built anew, in ``runs`` with paths of their own, until a pair at the threshold is found with
probability ``recall`` even if every node on its way is split to the last level; ``missed`` gives that
probability exactly. The default of one in a million takes 5 runs at 0.8. Lower thresholds take more; where
``MOST_RUNS`` can't reach the recall, ``join`` raises a ValueError that names what they reach.

Words are the white-space separated words of the lower-cased text; a text of one to four words is one
shingle; similarity is computed exactly on the sets of 64-bit shingle hashes.

Plan:

* equal texts are one class with its number of rows; only classes are joined, so a hot group of
  copies is one row;
* the tree moves (path, class) rows; counting a path is a partial aggregation; sketches travel only
  to buckets with several classes;
* a pair of a bucket is looked at only where it is the least bucket that both share, so it counts
  once without moving pairs; sizes and the first ``FILTER`` tokens (as many equal as a pair at the threshold
  has but for 1e-8; 11 at 0.8) leave few to verify;
* of buckets with the same members one stays, so near copies are not sent to each bucket that they share;
* shingle sets travel to the buckets that have a pair to verify; a bucket gives one number of links
  per class and a spanning forest, never its pairs. A bucket of n classes beyond ``BLOCK`` is dealt
  as pairs of blocks to as many tasks.

Defined cases: null texts are empty; equal texts are always linked as copies, empty ones too; a text
without words links to nothing else; the representative of a group is its least id (nulls last);
rows equal in id and text are copies like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import (GROUP, U64, bloom_split, components, deal_blocks, forest, fresh_matrix,
                                    fresh_pairs, map_batches, materialize, mix, prefix_hash, read_table, sorted_groups,
                                    span_hash, text_key)

THRESHOLD = 0.8
WORDS = 5
RECALL = 1 - 1e-6
MOST_RUNS = 64
DEPTH = 4
COORDS = 16            # coordinates of a level; every run starts at another level's
ROOT, PICK = 3, 2      # children that a set has at a root, and below
SMALL = 64             # classes of a bucket that is compared at once
BLOCK = 512            # classes of a block of a large bucket
ALIKE = 1 / PICK       # mean similarity from which a bucket is not split
JUDGED = 256           # sets, about, from which a node is judged
FILTER = 32            # tokens that are compared before sets are
_T = DEPTH * COORDS
_MUL = mix(np.arange(1, _T // 2 + 1, dtype=U64)) | U64(1)
_XOR = mix(np.arange(101, _T // 2 + 101, dtype=U64))
_AGAIN = U64(0xD6E8FEB86659FD93)


# -- recall --------------------------------------------------------------------------------------

def missed(threshold: float, runs: int) -> float:
    """Probability that a pair at the threshold shares no node of the last level in any run."""
    m = np.arange(COORDS + 1)
    chance = np.array([comb(COORDS, int(k)) * threshold ** k * (1 - threshold) ** (COORDS - k) for k in m])

    def shared(picks: int) -> np.ndarray:
        """[k, j]: j of the picked coordinates are equal if k of the level's are."""
        return np.array([[comb(int(k), j) * comb(COORDS - int(k), picks - j) / comb(COORDS, picks)
                          for j in range(picks + 1)] for k in m])

    def level(axis: int) -> np.ndarray:
        return m.reshape([-1 if i == axis else 1 for i in range(DEPTH)])

    weight = reduce(np.multiply, [chance[level(i)] for i in range(DEPTH)])
    lost = np.ones((COORDS + 1,) * DEPTH)
    for run in range(runs):
        found = np.ones((1,) * DEPTH)
        for depth in reversed(range(DEPTH)):
            p = shared(ROOT if depth == 0 else PICK)[level((depth + run) % DEPTH)]
            found = 1 - sum(p[..., j] * (1 - found) ** j for j in range(p.shape[-1]))
        lost = lost * (1 - found)
    return float((weight * lost).sum())


def runs_for(threshold: float, recall: float) -> int:
    """The least number of runs that finds a pair at the threshold with the probability ``recall``."""
    for runs in range(1, MOST_RUNS + 1):
        if missed(threshold, runs) <= 1 - recall:
            return runs
    raise ValueError(f"{MOST_RUNS} runs find a pair at similarity {threshold} with probability "
                     f"{1 - missed(threshold, MOST_RUNS):.6f}, not {recall}: ask for less recall or a higher threshold")


def least_match(threshold: float) -> int:
    """The equal tokens out of ``FILTER`` that a pair at the threshold has, but for a probability of 1e-8."""
    below = 0.0
    for k in range(FILTER + 1):
        below += comb(FILTER, k) * threshold ** k * (1 - threshold) ** (FILTER - k)
        if below > 1e-8:
            return k
    return FILTER


# -- sets --------------------------------------------------------------------------------------

def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    data = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=U64)
    gap = np.flatnonzero(data == 32)
    start, end = np.concatenate(([0], gap + 1)), np.append(gap, len(data))
    n = min(words, len(start))
    return np.unique(span_hash(prefix_hash(data), start[:len(start) - n + 1], end[n - 1:]))


def sketch(s: np.ndarray) -> bytes:
    """The embedded set: one token (minimum hash) per coordinate; a 64-bit hash gives two of them."""
    low = np.full((2, _T // 2), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(s), 1 << 15):
        part = (s[at:at + (1 << 15)] ^ _XOR[:, None]) * _MUL[:, None]
        part ^= part >> U64(32)  # a second round: one multiplication alone favours some shingles everywhere
        part *= _AGAIN
        low[0] = np.minimum(low[0], (part.min(axis=1) >> U64(32)).astype(np.uint32))
        part <<= U64(32)
        low[1] = np.minimum(low[1], (part.min(axis=1) >> U64(32)).astype(np.uint32))
    return low.T.tobytes()


def _similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """common / (a + b - common) >= threshold, within rounding of the threshold."""
    return common >= threshold * (a + b - common) - 1e-9


# -- tree --------------------------------------------------------------------------------------

def _tokens(depth: int) -> tuple[Column, Callable[[Column], Column]]:
    """First coordinate of a node's level, and the name of the child by a coordinate."""
    first = F.pmod(F.col("run") + depth, F.lit(DEPTH)) * COORDS
    return first, lambda at: F.xxhash64("path", at, F.call_function("substring", F.col("sketch"), at * 4 + 1, F.lit(4)))


def _children(depth: int) -> Column:
    """The children of a node that a set belongs to. Roots take coordinates of their own, other nodes
    those that their path names."""
    first, child = _tokens(depth)
    if depth == 0:
        start, step, picks = F.floor(F.col("run") / DEPTH).cast("int") * 4, F.lit(1), ROOT
    else:
        named = F.xxhash64("path")
        start = named.bitwiseAND(COORDS - 1).cast("int")
        step, picks = F.shiftright(named, 8).bitwiseAND(COORDS // 2 - 1).cast("int") * 2 + 1, PICK
    return F.array(*[child(first + (start + step * i) % COORDS) for i in range(picks)])


def _alike(nodes: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """The nodes (path) that are not to be split: the mean similarity of about ``JUDGED`` of their sets, as the
    share of pairs with equal tokens over all coordinates of the level, is ``ALIKE`` or more."""
    first, child = _tokens(depth)
    drawn = nodes.where(F.pmod(F.xxhash64("k1", "k2", "path"), F.col("n")) < JUDGED).join(sets, ["k1", "k2"])
    tokens = drawn.select("path", F.posexplode(F.array(*[child(first + i) for i in range(COORDS)])).alias("at", "token"))
    equal = tokens.groupBy("path", "at", "token").agg(F.count(F.lit(1)).alias("c"))
    one = equal.groupBy("path", "at").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return (one.groupBy("path").agg((F.sum("same") / F.sum(F.col("m") * (F.col("m") - 1))).alias("s"))
            .where(F.col("s") >= ALIKE).select("path"))


def _leaves(classes: DataFrame, runs: int) -> DataFrame:
    """Rows (path, n, k1, k2): the buckets to be compared by brute force."""
    sets = classes.where("size > 0").select("k1", "k2", "sketch")
    roots = F.explode(F.array(*[F.struct(F.lit(r + 1).cast("long").alias("path"), F.lit(r).alias("run"))
                                for r in range(runs)])).alias("t")
    nodes = sets.select(roots, "k1", "k2", "sketch").select("t.path", "t.run", "k1", "k2", "sketch")
    leaves = []
    for depth in range(DEPTH):
        kids = nodes.select(F.explode(_children(depth)).alias("path"), "run", "k1", "k2")
        if depth:
            kids = materialize(kids, "kids")
        several = kids.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        now = materialize(kids.join(several, "path").select("path", "n", "run", "k1", "k2"), "nodes")
        leaves.append(now.where(F.col("n") <= SMALL).select("path", "n", "k1", "k2"))
        large = now.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH - 1:
            leaves.append(large.select("path", "n", "k1", "k2"))
            break
        alike = materialize(_alike(large, sets, depth + 1), "alike")
        leaves.append(large.join(alike, "path", "left_semi").select("path", "n", "k1", "k2"))
        nodes = large.join(alike, "path", "left_anti").join(sets, ["k1", "k2"]).select("path", "run", "k1", "k2", "sketch")
    return _distinct(materialize(reduce(DataFrame.unionByName, leaves), "leaves"))


def _distinct(leaves: DataFrame) -> DataFrame:
    """The least of the buckets with the same members: near copies share most of theirs. Buckets are the same if
    their counts and both exclusive-or sums of the members' hashes (128 bits) are."""
    buckets = leaves.groupBy("path").agg(F.first("n").alias("n"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    kept = buckets.groupBy("n", "x1", "x2").agg(F.min("path").alias("path")).select("path")
    return materialize(leaves.join(kept, "path", "left_semi"), "buckets")


# -- buckets -----------------------------------------------------------------------------------

def _pairs(path: int, sizes: np.ndarray, sketches: np.ndarray, leaves: list[list[int]], side: np.ndarray | None,
           threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that are to be verified here. ``side``: blocks of the members; only pairs
    across blocks count, if there are two."""
    n = len(sizes)
    equal = np.zeros((n, n), dtype=np.uint8)
    for c in range(sketches.shape[1]):
        equal += sketches[:, c][:, None] == sketches[:, c]
    ok = np.triu(equal >= least_match(threshold), 1)
    ok &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    if side is not None:
        ok &= side[:, None] != side
    if n > SMALL and ok.sum() > 4 * n:
        ok &= fresh_matrix(path, leaves)
        return np.nonzero(ok)
    i, j = np.nonzero(ok)
    if len(i):
        f = fresh_pairs(path, leaves, i, j)
        i, j = i[f], j[f]
    return i, j


def _verify(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs have the similarity, exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                           for a, b in zip(i.tolist(), j.tolist())], dtype=np.int64)
    else:
        values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        who = np.repeat(np.arange(len(sets)), sizes)
        use = n[at] > 1
        renamed = np.cumsum(n > 1) - 1
        at, who = renamed[at[use]], who[use]
        total = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):
            a, b = np.searchsorted(at, (low, low + 8192))
            m = np.zeros((len(sets), 8192), dtype=np.float32)
            m[who[a:b], at[a:b] - low] = 1
            total += m @ m.T
        common = total[i, j].astype(np.int64)
    return _similar(common, sizes[i], sizes[j], threshold)


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """Members (path, bi, bj, blk, k1, k2) that have a pair to verify in their group."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        out = [[] for _ in range(6)]
        for (path, bi, bj), parts in sorted_groups(batches, 3):
            t = pa.Table.from_batches(parts)
            if t.num_rows > 1:
                blk = t.column("blk").to_numpy()
                sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, FILTER)
                i, j = _pairs(path, t.column("size").to_numpy(), sk, t.column("leaves").to_pylist(),
                              blk if bi != bj else None, threshold)
                need = np.union1d(i, j)
                if len(need):
                    for o, c in zip(out, (np.full(len(need), path), np.full(len(need), bi), np.full(len(need), bj),
                                          blk[need], t.column("k1").to_numpy()[need], t.column("k2").to_numpy()[need])):
                        o.append(c)
            if len(out[0]) >= 512:
                yield _batch(out)
                out = [[] for _ in range(6)]
        if out[0]:
            yield _batch(out)

    return rows.mapInArrow(run, "path long, bi int, bj int, blk int, k1 long, k2 long")


def _batch(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=k) for c, k in zip(out, kinds)],
                                      names=["path", "bi", "bj", "blk", "k1", "k2"])


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """(k1, k2, links, p1, p2): links found in a group, or (links 0) an edge of its spanning forest."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (path, bi, bj), parts in sorted_groups(batches, 3):
            t = pa.Table.from_batches(parts)
            sets = [np.frombuffer(s, dtype=U64) for s in t.column("set").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, FILTER)
            i, j = _pairs(path, sizes, sk, t.column("leaves").to_pylist(),
                          t.column("blk").to_numpy() if bi != bj else None, threshold)
            ok = _verify(i, j, sets, threshold) if len(i) else np.zeros(0, dtype=bool)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            m, k1, k2 = t.column("m").to_numpy(), t.column("k1").to_pylist(), t.column("k2").to_pylist()
            links = np.bincount(i, weights=m[j], minlength=len(m)) + np.bincount(j, weights=m[i], minlength=len(m))
            for at in np.flatnonzero(links):
                out.append((k1[at], k2[at], int(links[at]), None, None))
            for a, b in forest(len(m), i, j):
                out.append((k1[a], k2[a], 0, k1[b], k2[b]))
            if len(out) > 4096:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)

    return rows.mapInArrow(run, "k1 long, k2 long, links long, p1 long, p2 long")


def _link_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)],
                                      names=["k1", "k2", "links", "p1", "p2"])


# -- the operator --------------------------------------------------------------------------------

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *text_key(text_col), F.xxhash64(F.col(id_col), text).alias("r1"),
                       F.col(text_col).alias("text"))


def _earlier() -> Column:
    """A member's buckets before this one: those that tell whether a pair has been looked at."""
    return F.filter("leaves", lambda p: p < F.col("path")).alias("leaves")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, component_id (least id reachable by links), n_links (other rows
    linked directly), n_copies (rows with the same text), kept (this row stays for its group), and the
    row's keys (k1, k2, r1)."""
    runs = runs_for(threshold, recall)
    rows = _keyed(docs, id_col, text_col)

    def describe(k1, k2, r1, ids, texts):
        sets = [shingles(t) for t in texts]
        return k1, k2, r1, ids, [len(s) for s in sets], [sketch(s) if len(s) else None for s in sets]

    kind = dict(rows.dtypes)["doc_id"]
    made = map_batches(rows.select("k1", "k2", "r1", "doc_id", "text"), describe,
                       f"k1 long, k2 long, r1 long, doc_id {kind}, size int, sketch binary")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1")
    classes = materialize(made.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("m"), F.min(first).alias("rep"), F.first("size").alias("size"),
        F.first("sketch").alias("sketch")), "classes")
    leaves = _leaves(classes, runs)
    listed = leaves.groupBy("k1", "k2").agg(F.collect_list("path").alias("leaves"))  # runs * ROOT * PICK^(DEPTH - 1) at most
    info = materialize(classes.join(listed, ["k1", "k2"]).select(
        "k1", "k2", "m", "size", F.call_function("substring", F.col("sketch"), F.lit(1), F.lit(4 * FILTER)).alias("sketch"),
        "leaves"), "info")
    dealt = deal_blocks(leaves, BLOCK)
    order = [*GROUP, "k1", "k2"]
    groups = (dealt.join(info, ["k1", "k2"]).select(*GROUP, "blk", "k1", "k2", "size", "sketch", _earlier())
              .repartition(*GROUP).sortWithinPartitions(*order))
    need = materialize(_candidates(groups, threshold), "need")
    # the sets of those that have a pair to verify, from one row of each class
    who = materialize(need.select("k1", "k2").distinct().join(classes.select("k1", "k2", "rep.r1"), ["k1", "k2"]), "who")
    text = bloom_split(rows, who, "r1")[0].join(who, ["k1", "k2", "r1"], "left_semi").select("k1", "k2", "text")

    def build(k1, k2, texts):
        return k1, k2, [shingles(t).tobytes() for t in texts]

    # rows equal in id and text give the same set more than once
    sets = map_batches(text, build, "k1 long, k2 long, set binary").dropDuplicates(["k1", "k2"])
    whole = materialize(sets.join(info, ["k1", "k2"]), "sets")
    checked = (need.join(whole, ["k1", "k2"])
               .select(*GROUP, "blk", "k1", "k2", "m", "sketch", _earlier(), "set")
               .repartition(*GROUP).sortWithinPartitions(*order))
    found = materialize(_links(checked, threshold), "links")
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    edges = found.where("p1 IS NOT NULL").select(F.struct("k1", "k2").alias("a"),
                                                 F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("b"))
    roots = components(edges).select("node.k1", "node.k2", "root")
    grouped = materialize(classes.select("k1", "k2", "m", "rep").join(roots, ["k1", "k2"], "left").join(
        links, ["k1", "k2"], "left").withColumn("root", F.coalesce("root", F.struct("k1", "k2"))), "grouped")
    keeper = (grouped.where(F.col("links").isNotNull()).groupBy("root").agg(F.min("rep").alias("keeper")))
    result = (grouped.join(keeper, "root", "left")
              .select("k1", "k2", "m", F.coalesce("links", F.lit(0)).alias("links"),
                      F.coalesce("keeper", "rep").alias("keeper")))
    plain = rows.select("doc_id", "k1", "k2", "r1")
    return plain.join(result, ["k1", "k2"]).select(
        "doc_id", F.col("keeper.doc_id").alias("component_id"), (F.col("m") - 1 + F.col("links")).alias("n_links"),
        F.col("m").alias("n_copies"), (F.col("r1") == F.col("keeper.r1")).alias("kept"), "k1", "k2", "r1")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs``, with all columns, without the rows that do not stay for their group. Rows equal in id
    and text can't be told apart: one of them stays. Texts are joined only where a Bloom filter of
    fixed size names them as touched."""
    verdict = join(docs, id_col, text_col, threshold, recall).groupBy("k1", "r1").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    touched = materialize(verdict.where(~F.col("kept") | (F.col("rows") > 1)), "touched")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    row = F.xxhash64(F.col(names[docs.columns.index(id_col)]), F.coalesce(F.col(text), F.lit(""))).alias("r1")
    keyed = plain.select(*names, text_key(text)[0], row)
    hit, miss = bloom_split(keyed, touched, "r1")
    held = hit.join(touched, ["k1", "r1"], "left")
    single = held.where(F.col("kept").isNull()).select(*names)
    several = held.where("kept").dropDuplicates(["k1", "r1"]).select(*names)
    return miss.select(*names).unionByName(single).unionByName(several).toDF(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents")).select("doc_id", "component_id", "n_links", "n_copies", "kept")
