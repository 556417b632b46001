"""Suffix-array deduplication: remove every byte covered by a long string that also starts elsewhere.

Texts are UTF-8 bytes; a window is a string of ``length`` bytes inside one document; a window is
repeated if the same bytes start at any other place of the corpus (same document included), judged on
the input. All bytes of repeated windows go.

Plan, exact at every size:

1. Every window belongs to the least hash of its ``length // 4``-byte substrings. Consecutive windows
   with the same least hash form a run; equal windows have equal least hashes, so only runs whose hash
   is met more than once (in several runs, or at several places of one) are kept. This takes (hash,
   run hash, document key, place), no text.
2. Runs with equal bytes are one string with a multiplicity. Hashes with different strings send one
   copy of each string to a bucket per hash. Strings of a crowded bucket (say a passage in very many
   documents) are cut again by the least hash of longer substrings. Buckets that are still crowded
   (the strings at the passage's edges share all but the bytes around it) are decided by whole
   windows: a partially aggregated count per 128-bit window hash, so only buckets of at most
   ``CROWDED`` strings and ``CROWDED * 1024`` windows reach a suffix array.
3. Inside a bucket a suffix array by linear grouping (``gsaca``) decides. Suffixes start at anchors
   (least 8-byte hash of each ``SPARSE`` places; about one in 25 bytes); a symbol is the rank of the
   bytes that determine the next anchor, so the order of symbol strings is the order of byte strings.
   Neighbours' longest common prefixes cut the array into intervals; a window at distance d before
   its anchor is repeated iff its anchor's interval at length - d holds another anchor with the same
   d bytes to its left.
4. Repeated places are joined to the documents by row key. Untouched documents are told apart by a
   Bloom filter of fixed size (false hits only cost a join), so their texts are not shuffled.

Defined cases: null texts are empty; texts shorter than ``length`` keep everything; rows are judged
one by one, so equal rows are copies of each other, repeated ids and null ids included. Extra columns
are ignored by the report and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import (U64, bloom_split, map_batches, materialize, prefix_hash, read_table, signed,
                                    sliding_min, sorted_groups, span_hash)
from featuremart.llm.gsaca import suffix_array

LENGTH = 400          # bytes of a repeated string
SPARSE, GRAM = 48, 8  # anchors: least hash of GRAM bytes among SPARSE places
CROWDED = 512         # different strings of a bucket before it is cut again, or windows / 1024
BLOCK = 1 << 21       # windows of a text handled at once
BATCH = 1 << 20       # bytes of whole buckets sorted together
COUNTED = 1 << 14     # windows of a batch of counted ones


# -- step 1: runs ------------------------------------------------------------------------------

def runs_of(data: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    """(least hash, hash of the run's bytes, first window, end of windows, whether the least hash is met
    at several places of the block) arrays of a text."""
    w = length - gram + 1
    windows = len(data) - length + 1
    for at in range(0, max(0, windows), BLOCK):
        many = min(BLOCK, windows - at)
        part = data[at:at + many + length - 1]
        p = prefix_hash(part)
        i = np.arange(len(part) - gram + 1)
        grams = span_hash(p, i, i + gram)
        least = sliding_min(grams, w)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.append(first[1:], many)
        # a place that is the least of some window equals the greatest least of all windows over it
        over = np.zeros(many + 2 * (w - 1), dtype=U64)
        over[w - 1:w - 1 + many] = least
        met, n = np.unique(grams[grams == ~sliding_min(~over, w)], return_counts=True)
        twice = np.isin(least[first], met[n > 1]) if (n > 1).any() else np.zeros(len(first), dtype=bool)
        yield least[first], span_hash(p, first, end + length - 1), first + at, end + at, twice


def _row_key(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(F.lit(7), text, F.col(id_col)).alias("r2")]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _runs(rows: DataFrame, length: int) -> DataFrame:
    """Rows (v, seg, r1, r2, a, b, twice) of every run of rows (r1, r2, text)."""
    def run(r1, r2, texts):
        out = [[] for _ in range(7)]
        for x, y, t in zip(r1, r2, texts):
            for v, seg, a, b, twice in runs_of(_bytes(t), length, length // 4):
                for o, c in zip(out, (signed(v), signed(seg), np.full(len(a), x), np.full(len(a), y), a, b, twice)):
                    o.append(c)
        return [np.concatenate(o) if o else [] for o in out]

    return map_batches(rows, run, "v long, seg long, r1 long, r2 long, a int, b int, twice boolean")


# -- step 3: one batch of buckets ----------------------------------------------------------------

def repeated(strings: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For every string a flag per window: does the window start anywhere else among the strings?
    Equal strings must come as one with its number of copies."""
    raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
    size = np.array([len(s) for s in strings])
    ends = np.cumsum(size)
    begins = ends - size
    p = prefix_hash(raw)
    # anchors of every string, and the anchor of every window
    pos, owner, w_start, w_anchor, w_owner = [], [], [], [], []
    count = 0
    at = np.arange(len(raw) - GRAM + 1)
    grams = span_hash(p, at, at + GRAM) >> U64(24)
    for s in range(len(strings)):
        n = int(size[s]) - GRAM + 1
        tag = (grams[begins[s]:begins[s] + n] << U64(24)) | np.arange(n, dtype=U64)  # leftmost of equals
        low = (sliding_min(tag, SPARSE) & U64((1 << 24) - 1)).astype(np.int64)
        new = np.concatenate(([True], low[1:] != low[:-1]))
        index = np.cumsum(new) - 1 + count
        windows = int(size[s]) - length + 1
        pos.append(low[new] + begins[s])
        owner.append(np.full(int(new.sum()), s))
        w_start.append(np.arange(windows) + begins[s])
        w_anchor.append(index[:windows])
        w_owner.append(np.full(windows, s))
        count += int(new.sum())
    pos, owner = np.concatenate(pos), np.concatenate(owner)
    w_start, w_anchor, w_owner = map(np.concatenate, (w_start, w_anchor, w_owner))
    # symbols: ranks of the bytes that determine the next anchor; a string's end sorts lowest
    width = SPARSE + GRAM
    col = np.arange(width)
    where = pos[:, None] + col
    inside = where < ends[owner][:, None]
    view = np.where(inside, raw[np.minimum(where, len(raw) - 1)] + np.uint8(1), 0).astype(np.uint8)
    _, rank = np.unique(np.ascontiguousarray(view).view(f"S{width}").ravel(), return_inverse=True)
    cut = ~inside[:, -1]
    order = np.lexsort((np.where(cut, owner + 1, 0), rank))
    differs = np.ones(len(order), dtype=bool)
    differs[1:] = (rank[order][1:] != rank[order][:-1]) | cut[order][1:]
    symbol = np.empty(len(order), dtype=np.int64)
    symbol[order] = np.cumsum(differs) - 1
    sa = np.array(suffix_array(symbol.tolist()), dtype=np.int64)
    # bytes in common of neighbours, up to the length
    common = np.zeros(len(sa), dtype=np.int64)
    x, y, row = sa[:-1].copy(), sa[1:].copy(), np.arange(1, len(sa))
    base = pos[x]
    while len(row):
        same = symbol[x] == symbol[y]
        stop = ~same
        if stop.any():
            i, j = x[stop], y[stop]
            unequal = view[i] != view[j]
            # where both are cut at their ends with equal bytes, the common part ends with the bytes
            lcp = np.where(unequal.any(axis=1), unequal.argmax(axis=1), np.minimum(ends[owner[i]] - pos[i], width))
            common[row[stop]] = pos[i] - base[stop] + lcp
        x, y, row, base = x[same] + 1, y[same] + 1, row[same], base[same]
        far = pos[x] - base >= length if len(row) else np.zeros(0, dtype=bool)
        common[row[far]] = length
        x, y, row, base = x[~far], y[~far], row[~far], base[~far]
    place = np.empty(len(sa), dtype=np.int64)
    place[sa] = np.arange(len(sa))
    # windows by distance to their anchor
    gap = pos[w_anchor] - w_start
    left = span_hash(p, w_start, pos[w_anchor])
    many = np.array(copies)
    hit = many[w_owner] > 1
    by_gap = np.argsort(gap, kind="stable")
    bound = np.searchsorted(gap[by_gap], np.arange(SPARSE + 1))
    for d in range(SPARSE):
        w = by_gap[bound[d]:bound[d + 1]]
        if not len(w):
            continue
        interval = np.cumsum(common < length - d)[place[w_anchor[w]]]
        if d == 0:
            _, inv, n = np.unique(interval, return_inverse=True, return_counts=True)
        else:
            o = np.lexsort((left[w], interval))
            diff = np.ones(len(o), dtype=bool)
            diff[1:] = (interval[o][1:] != interval[o][:-1]) | (left[w][o][1:] != left[w][o][:-1])
            inv = np.empty(len(o), dtype=np.int64)
            inv[o] = np.cumsum(diff) - 1
            n = np.bincount(inv)
        hit[w] |= n[inv] > 1
    return np.split(hit, np.cumsum(size - length + 1)[:-1])


def spans_of(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[0::2].tolist(), edge[1::2].tolist()


# -- the operator ----------------------------------------------------------------------------------

def _crowded(strings: DataFrame, bucket: str) -> DataFrame:
    """The buckets with too many strings or windows for one task, of rows (bucket, windows)."""
    return (strings.groupBy(bucket).agg(F.count(F.lit(1)).alias("strings"), F.sum("windows").alias("windows"))
            .where((F.col("strings") > CROWDED) | (F.col("windows") > CROWDED * 1024)))


def _pieces(rows: DataFrame, one: DataFrame, length: int, gram: int | None = None) -> DataFrame:
    """Rows (g, v, seg, off, n, bytes): the strings ``one`` with their bytes, whole in the bucket of their
    hash or, with ``gram``, cut into buckets by the least hash of substrings of that size."""
    wanted = one.groupBy("r1", "r2").agg(
        F.collect_list(F.struct("v", "seg", "n", "a", "b")).alias("wanted"))  # at most a text's own runs
    wanted = materialize(wanted, "wanted")
    source = bloom_split(rows, wanted, "r1")[0].join(wanted, ["r1", "r2"]).select("wanted", "text")

    def cut(wanted, texts):
        out = [[] for _ in range(6)]  # bucket, v, seg, offset, copies, bytes
        for ws, t in zip(wanted, texts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            for w in ws:
                piece = raw[w["a"]:w["b"] + length - 1]
                if gram:
                    parts = [(int(x) ^ w["v"], int(a), int(b))
                             for v2, _, aa, bb, _ in runs_of(np.frombuffer(piece, np.uint8), length, gram)
                             for x, a, b in zip(signed(v2), aa, bb)]
                else:
                    parts = [(w["v"], 0, w["b"] - w["a"])]
                for g, a, b in parts:
                    for o, c in zip(out, (g, w["v"], w["seg"], a, w["n"], piece[a:b + length - 1])):
                        o.append(c)
        return out

    return map_batches(source, cut, "g long, v long, seg long, off int, n long, bytes binary")


def _counted(strings: DataFrame, length: int) -> DataFrame:
    """Rows (v, seg, x, y) of repeated windows of rows (v, seg, off, n, bytes), by the number of places
    of every window. Equal windows are in one bucket, so all places of a window are among the rows."""
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                v, seg, off, n, raw = (c[k].as_py() for c in b.columns)
                view, end = memoryview(raw), len(raw) - length + 1
                for at in range(0, end, COUNTED):
                    m = min(COUNTED, end - at)
                    h = b"".join(hashlib.blake2b(view[i:i + length], digest_size=16).digest()
                                 for i in range(at, at + m))
                    h = np.frombuffer(h, dtype="<i8").reshape(m, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (h[:, 0].copy(), h[:, 1].copy(), np.full(m, v), np.full(m, seg),
                                               np.arange(off + at, off + at + m, dtype=np.int32), np.full(m, n))],
                        names=["h1", "h2", "v", "seg", "x", "n"])

    windows = strings.select("v", "seg", "off", "n", "bytes").mapInArrow(
        run, "h1 long, h2 long, v long, seg long, x int, n long")
    many = (windows.groupBy("h1", "h2").agg(F.sum("n").alias("places")).where("places > 1")
            .select(F.col("h1").alias("m1"), F.col("h2").alias("m2")))
    many = materialize(many, "many")  # so that a window of very many places is a skewed join that AQE splits
    hit = (windows.join(many, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")), "left_semi")
           .groupBy("v", "seg").agg(F.sort_array(F.collect_list("x")).alias("xs")))  # at most a run's own windows

    def join(vs, segs, places):
        out = [[] for _ in range(4)]
        for v, seg, xs in zip(vs, segs, places):
            at = np.array(xs, dtype=np.int64)
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            last = np.append(first[1:], len(at)) - 1
            for x, y in zip(at[first].tolist(), (at[last] + 1).tolist()):
                for o, c in zip(out, (v, seg, x, y)):
                    o.append(c)
        return out

    return map_batches(hit.select("v", "seg", "xs"), join, "v long, seg long, x int, y int")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (r1, r2, spans): by row key, the byte intervals of repeated windows, merged later. Only
    documents with such windows have a row."""
    assert length >= 2 * (SPARSE + GRAM)
    rows = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("text"))
    runs = _runs(rows, length)
    stat = (runs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"),
                                  F.max("twice").alias("twice"))
            .where((F.col("n") > 1) | F.col("twice"))
            .select(F.col("v").alias("v0"), ((F.col("lo") != F.col("hi")) | F.col("twice")).alias("mixed")))
    kept = materialize(runs.drop("twice").join(stat, F.col("v") == F.col("v0")).drop("v0"), "runs")
    mixed = kept.where("mixed")
    # one copy of each different string
    one = mixed.groupBy("v", "seg").agg(F.count(F.lit(1)).alias("n"),
                                        F.min(F.struct("r1", "r2", "a", "b")).alias("s"))
    one = materialize(one.select("v", "seg", "n", "s.*"), "strings")
    crowd = _crowded(one.select("v", (F.col("b") - F.col("a")).alias("windows")), "v").select("v")
    plain = _pieces(rows, one.join(crowd, "v", "left_anti"), length)
    cut = materialize(_pieces(rows, one.join(crowd, "v", "left_semi"), length, length - length // 8), "cut")
    windows = (F.octet_length("bytes") - (length - 1)).alias("windows")
    still = materialize(_crowded(cut.select("g", windows), "g").select("g"), "crowded")
    strings = plain.unionByName(cut.join(still, "g", "left_anti"))
    dealt = strings.repartition("g").sortWithinPartitions("g", "v", "seg", "off")

    def judge(batches):
        held, size = [], 0
        for _, parts in sorted_groups(batches, 1):
            held.append(pa.Table.from_batches(parts))
            size += held[-1].column("bytes").nbytes
            if size >= BATCH:
                yield from _judged(held, length)
                held, size = [], 0
        if held:
            yield from _judged(held, length)

    found = dealt.mapInArrow(judge, "v long, seg long, x int, y int")
    found = found.unionByName(_counted(cut.join(still, "g", "left_semi"), length))
    found = materialize(found, "found")
    whole = kept.where("NOT mixed").select("r1", "r2", "a", "b")
    part = (mixed.join(found, ["v", "seg"])
            .select("r1", "r2", (F.col("a") + F.col("x")).alias("a"), (F.col("a") + F.col("y")).alias("b")))
    spans = whole.unionByName(part).select("r1", "r2", F.struct("a", (F.col("b") + (length - 1)).alias("b")).alias("s"))
    return materialize(spans.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("s")).alias("spans")), "spans")


def _judged(tables: list[pa.Table], length: int) -> Iterator[pa.RecordBatch]:
    """Buckets sorted together (their windows differ, as their hashes do)."""
    table = pa.concat_tables(tables)
    index: dict[tuple[int, bytes], int] = {}
    strings, copies, who = [], [], []
    for g, n, raw in zip(*[table.column(c).to_pylist() for c in ("g", "n", "bytes")]):
        at = index.setdefault((g, raw), len(strings))
        if at == len(strings):
            strings.append(raw)
            copies.append(0)
        copies[at] += n
        who.append(at)
    flags = [spans_of(f) for f in repeated(strings, copies, length)]
    out = [[], [], [], []]
    for v, seg, off, at in zip(*[table.column(c).to_pylist() for c in ("v", "seg", "off")], who):
        for x, y in zip(*flags[at]):
            for o, c in zip(out, (v, seg, off + x, off + y)):
                o.append(c)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                          pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
                                         names=["v", "seg", "x", "y"])


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of sorted intervals."""
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [tuple(x) for x in out]


def keep(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


REPORT = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row what was removed and the digest of what is left."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", *_row_key("doc_id", "text"), "text")
    spans = removals(rows, "doc_id", "text", length)
    hit, miss = bloom_split(keyed, spans, "r1")
    size = F.octet_length("text").cast("long")
    same = miss.select(
        "doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))

    def run(ids, texts, spans):
        out = [[] for _ in range(5)]
        for i, t, s in zip(ids, texts, spans):
            raw, merged = t.encode("utf-8", "surrogatepass"), merge(s)
            left = keep(raw, merged)
            row = (i, len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest())
            for o, c in zip(out, row):
                o.append(c)
        return out

    touched = hit.join(spans, ["r1", "r2"], "left").select("doc_id", "text", "spans")
    return same.unionByName(map_batches(touched, run, REPORT.format(id=kind)))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars",
           length: int = LENGTH) -> DataFrame:
    """``docs``, all rows and columns, without the repeated bytes in ``text_col`` (a character that is
    removed in part goes whole) and with ``size_col`` the new number of characters."""
    spans = removals(docs, id_col, text_col, length)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    keyed = plain.select(*names, *_row_key(names[docs.columns.index(id_col)], text))

    hit, miss = bloom_split(keyed, spans, "r1")
    touched = hit.join(spans, ["r1", "r2"], "left").select(*names, "spans")
    text_at = names.index(text)
    size_at = docs.columns.index(size_col) if size_col and size_col in docs.columns else None

    def edit(batches):
        for b in batches:
            found = b.column(len(names)).to_pylist()
            old = b.column(text_at).to_pylist()
            new = [t if s is None else keep(t.encode("utf-8", "surrogatepass"), merge(s)).decode("utf-8", "ignore")
                   for t, s in zip(old, found)]
            cols = b.columns[:-1]
            cols[text_at] = pa.array(new, type=cols[text_at].type)
            if size_at is not None:
                sizes = [n if s is None else len(t) for n, s, t in zip(cols[size_at].to_pylist(), found, new)]
                cols[size_at] = pa.array(sizes, type=cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    touched = touched.mapInArrow(edit, touched.select(*names).schema)
    return miss.select(*names).unionByName(touched.select(*names)).toDF(*docs.columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))
