"""Prefix trie of conversations that share heads, by composable monoid fingerprints.

A conversation ``c`` is rebuilt from the head of its base conversation (``c - c % 5``) and its own
turns after its head. No rebuilt text is ever made. A sequence of turns has the fingerprint
``(length, sum of x_j * w^j modulo 2^61 - 1)`` in two lanes, ``x_j`` the hash of its j-th turn: a monoid
element, so ``F(ab) = F(a) + w^|a| F(b)``. Every original conversation is scanned once; a rebuilt prefix is
the base's head product combined with a quotient of two of its own prefix products. UTF-8 bytes are
summed the same way.

Plan. Turns are dealt by range of (conversation, turn), so that a conversation with a third of all rows is
spread over tasks, and the parts' products are combined by their offsets (two parts a task at most are
not whole). A rebuilt prefix is a narrow row with a reference to the stored turn that ends it. Rows of one
(depth, fingerprint) are a node. Groups verify equality through these references: a group whose members end in
the same stored turn is equal as its parent group is; other groups compare the texts of their different
references. A false meeting would repeat the run with other hashes, so results are exact.

Subtree sums need no walk. The least member of a node owns it, and a conversation owns a chain of nodes down to its
end, so a subtree holds the whole chains of its members but for its owner's nodes above it: sums over a
node's members of per-conversation numbers give leaves and bytes of the subtree.

Defined cases: null role or text counts as empty; null turns come first, equal turns go by role, then text, and
repeated rows are turns of their own; rows with a null conversation id belong to none and make no node; ids are
integers and ``%`` truncates as in SQL; no rows give no node, not even a root. Other columns are ignored. The digest
of a node's ended members reads their sorted ids as a stream in one task, without holding them (a hash can't be
combined from parts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featuremart.llm.common import U64, materialize, mix, read_table, ship

P = (1 << 61) - 1
SPAN, HEADS = 5, 9  # conversations of a base; heads have 0 to 8 turns
KEY = ["depth", "f1", "f2"]
NO_IDS = hashlib.sha256(b"").hexdigest()


# -- products modulo 2^61 - 1 ----------------------------------------------------------------------

def _fold(t: np.ndarray) -> np.ndarray:
    t = (t & U64(P)) + (t >> U64(61))
    return np.where(t >= U64(P), t - U64(P), t)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below 2^61 - 1, by halves of 31 bits."""
    low = U64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U64(31), a & low, b >> U64(31), b & low
    mid = a1 * b0 + a0 * b1
    return _fold(U64(2) * a1 * b1 + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + a0 * b0)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _fold(a + b)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _fold(a + (U64(P) - b))


def running(x: np.ndarray) -> np.ndarray:
    """Running sums."""
    high = np.cumsum(x >> U64(31))
    return add(mul(_fold(high), np.full(len(x), 1 << 31, dtype=U64)), _fold(np.cumsum(x & U64((1 << 31) - 1))))


class Powers:
    """Powers of a lane's base, also with negative exponents."""
    STEP = 4096

    def __init__(self, salt: int, lane: int) -> None:
        self.base = int(mix(np.array([salt * 2 + lane + 1], dtype=U64))[0] % U64(P - 2)) + 2
        self.low = np.array([pow(self.base, i, P) for i in range(self.STEP)], dtype=U64)
        self.high = np.ones(1, dtype=U64)

    def __call__(self, n: np.ndarray) -> np.ndarray:
        """For exponents from ``-STEP`` on."""
        n = n + self.STEP
        top = int(n.max(initial=0)) // self.STEP + 1
        if len(self.high) < top:
            step = pow(self.base, self.STEP, P)
            self.high = np.array([pow(step, i, P) for i in range(top)], dtype=U64)
        back = np.full(len(n), pow(self.base, -self.STEP, P), dtype=U64)
        return mul(mul(self.low[n % self.STEP], self.high[n // self.STEP]), back)


def lanes(salt: int) -> tuple[Powers, Powers]:
    return Powers(salt, 0), Powers(salt, 1)


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


# -- prefix products of the original conversations ---------------------------------------------------

STORED = ("conv_id long, part int, pos long, ref long, v1 long, v2 long, u1 long, u2 long, bytes long, "
          "own_bytes long, role string, text string")


def _stored_turns(turns: DataFrame, salt: int) -> DataFrame:
    """Turns in order with the products of each task's part of a conversation through a turn (``v``) and
    before it (``u``)."""
    ordered = (turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16),
                                        F.substring("text", 1, 16))
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
               .select("conv_id", F.xxhash64(F.lit(salt), "role", "text").alias("k1"),
                       F.xxhash64(F.lit(~salt), "text", "role").alias("k2"),
                       F.octet_length("text").cast("long").alias("own_bytes"), "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        powers = lanes(salt)
        row = 0
        held = None  # conversation, position, products, bytes of the row before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, size = _ints(batch, "conv_id"), _ints(batch, "own_bytes")
            new = np.ones(n, dtype=bool)
            new[1:] = conv[1:] != conv[:-1]
            goes_on = held is not None and held[0] == conv[0]
            run_of = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            lead = np.zeros(n, dtype=bool)
            if goes_on:
                lead = run_of == 0
            pos = np.arange(n) - first[run_of] + 1 + np.where(lead, held[1] if goes_on else 0, 0)
            through, before = [], []
            for i, k in enumerate(("k1", "k2")):
                x = _fold(_ints(batch, k).view(U64))
                term = mul(x, powers[i](pos))
                total = running(term)
                v = sub(total, sub(total[first], term[first])[run_of])
                v = np.where(lead, add(v, np.full(n, held[2][i] if goes_on else 0, dtype=U64)), v)
                through.append(v)
                before.append(sub(v, term))
            summed = np.cumsum(size)
            summed = summed - (summed[first] - size[first])[run_of] + np.where(lead, held[3] if goes_on else 0, 0)
            ref = (np.int64(part) << np.int64(40)) + np.arange(row, row + n)
            row += n
            held = (conv[-1], int(pos[-1]), [int(v[-1]) for v in through], int(summed[-1]))
            cols = [conv, np.full(n, part, dtype=np.int32), pos, ref, *[v.view(np.int64) for v in through],
                    *[u.view(np.int64) for u in before], summed, size]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c) for c in cols], batch.column("role"), batch.column("text")],
                names=[c.split()[0] for c in STORED.split(", ")])

    return ordered.mapInArrow(run, STORED)


def _offsets(stored: DataFrame, salt: int) -> DataFrame:
    """(conv_id, part, at, o1, o2, o_bytes) of the later parts of conversations in several parts: what comes before
    them. A task's part of the range has at most two conversations that aren't whole."""
    parts = stored.groupBy("conv_id", "part").agg(
        F.max("pos").alias("n"), *[F.max_by(c, "pos").alias(c) for c in ("v1", "v2")], F.max("bytes").alias("bytes"))
    several = parts.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).where("parts > 1")

    def run(pdf):
        pdf = pdf.sort_values("part")
        powers = lanes(salt)
        at, size, v = 0, 0, [0, 0]
        out = []
        for r in pdf.itertuples():
            if at:
                out.append((r.conv_id, r.part, at, v[0], v[1], size))
            for i, x in enumerate((r.v1, r.v2)):
                v[i] = (v[i] + pow(powers[i].base, at, P) * int(x)) % P
            at, size = at + int(r.n), size + int(r.bytes)
        import pandas as pd
        return pd.DataFrame(out, columns=["conv_id", "part", "at", "o1", "o2", "o_bytes"])

    return several.select("conv_id", "part", "n", "v1", "v2", "bytes").groupBy("conv_id").applyInPandas(
        run, "conv_id long, part int, at long, o1 long, o2 long, o_bytes long")


def _products(rows: DataFrame, salt: int, keep: list[str]) -> DataFrame:
    """``o + w^at * (v - m)`` and the same of ``u``: a product that follows another one, without its own head ``m``."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + \
        ", v1 long, v2 long, u1 long, u2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = lanes(salt)
        for batch in batches:
            w = [p(_ints(batch, "at")) for p in powers]
            out = []
            for c in ("v1", "v2", "u1", "u2"):
                i = int(c[1]) - 1
                o, m, x = (_ints(batch, f"{s}{i + 1}" if s != c[0] else c).view(U64) for s in ("o", "m", c[0]))
                out.append(pa.array(add(o, mul(w[i], sub(x, m))).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *out],
                                             names=[*keep, "v1", "v2", "u1", "u2"])

    return rows.mapInArrow(run, schema)


def _prefixes(stored: DataFrame, salt: int) -> DataFrame:
    """Every turn with the products of its whole conversation through and before it."""
    zero = F.lit(0).cast("long")
    rows = stored.drop("role", "text").join(_offsets(stored, salt), ["conv_id", "part"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("at", "o1", "o2", "o_bytes")})
    rows = rows.withColumns({"pos": F.col("pos") + F.col("at"), "bytes": F.col("bytes") + F.col("o_bytes"),
                             "m1": zero, "m2": zero})
    return _products(rows, salt, ["conv_id", "pos", "ref", "bytes", "own_bytes"])


# -- rebuilt conversations ---------------------------------------------------------------------------

def head_turns(conv: str) -> Column:
    return (F.crc32(F.col(conv).cast("string")) % HEADS).cast("int")


def _plans(prefixes: DataFrame) -> DataFrame:
    """One row per conversation: its base's head, where both are joined, its rebuilt length and bytes."""
    h = head_turns("conv_id")
    at_h = lambda c: F.coalesce(F.max(F.when(F.col("pos") == h, F.col(c))), F.lit(0).cast("long"))
    own = prefixes.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("bytes").alias("all_bytes"), at_h("v1").alias("m1"), at_h("v2").alias("m2"),
        at_h("bytes").alias("m_bytes")).withColumn("h", h)
    turn = F.struct("pos", "v1", "v2", "u1", "u2", "ref", "bytes", "own_bytes")
    heads = (prefixes.where((F.col("pos") < HEADS) & (F.col("conv_id") % SPAN == 0)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(turn)).alias("head"))  # eight turns at most
             .select(F.col("conv_id").alias("base"), "head"))
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % SPAN == F.col("base"), "left")
    joined = joined.withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    joined = joined.withColumn("head", F.when(F.col("k") > 0, F.slice("head", F.lit(1), F.col("k"))))
    joint = F.when(F.col("k") > 0, F.element_at("head", F.col("k")))
    zero = F.lit(0).cast("long")
    goes_on = F.col("n") > F.col("h")
    return joined.select(
        "conv_id", "h", "k", "head", "m1", "m2", "m_bytes",
        *[F.coalesce(joint[a], zero).alias(b) for a, b in (("v1", "o1"), ("v2", "o2"), ("bytes", "o_bytes"))],
        (F.col("k") + F.when(goes_on, F.col("n") - F.col("h")).otherwise(zero)).alias("length"),
        (F.coalesce(joint["bytes"], zero) + F.when(goes_on, F.col("all_bytes") - F.col("m_bytes")).otherwise(zero))
        .alias("total"))


def _rebuilt(prefixes: DataFrame, plans: DataFrame, salt: int) -> DataFrame:
    """Every prefix of every rebuilt conversation: (conv_id, depth, fingerprint, the parent's, reference to its last
    turn, bytes through it and of it, whether it is the whole)."""
    names = ["conv_id", "depth", "v1", "v2", "u1", "u2", "ref", "bytes", "own_bytes", "ends"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = plans.select("conv_id", zero, zero, zero, none, none, none, zero, zero, F.col("length") == 0).toDF(*names)
    t = F.col("t")
    heads = plans.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", t["pos"], t["v1"], t["v2"], t["u1"], t["u2"], t["ref"], t["bytes"], t["own_bytes"],
        F.col("length") == t["pos"]).toDF(*names)
    own = prefixes.join(plans.drop("head", "total"), "conv_id").where(F.col("pos") > F.col("h")).withColumns(
        {"at": (F.col("k") - F.col("h")).cast("long"), "depth": F.col("pos") - F.col("h") + F.col("k"),
         "bytes": F.col("o_bytes") + F.col("bytes") - F.col("m_bytes")})
    own = _products(own.withColumn("ends", F.col("depth") == F.col("length")), salt,
                    ["conv_id", "depth", "ref", "bytes", "own_bytes", "ends"])
    rows = roots.unionByName(heads).unionByName(own)
    return rows.withColumnsRenamed({"v1": "f1", "v2": "f2", "u1": "p1", "u2": "p2"})


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[f(c).alias(f"{c}_{f.__name__}") for c in ("p1", "p2", "ref") for f in (F.min, F.max)],
        (F.min("bytes") - F.min("own_bytes")).alias("before"))


def _verified(nodes: DataFrame, rows: DataFrame, stored: DataFrame) -> bool:
    """Whether every node holds one sequence: one parent node, and equal turns behind its references."""
    parents = nodes.where("p1_min <> p1_max OR p2_min <> p2_max").select(*KEY)
    mixed = nodes.where("ref_min <> ref_max").select(*KEY)
    refs = rows.join(mixed, KEY, "left_semi").select(*KEY, "ref").distinct()
    turns = refs.join(stored.select("ref", "role", "text"), "ref").select(*KEY, "role", "text").distinct()
    differ = turns.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY)
    return parents.unionByName(differ).isEmpty()


def _digests(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes in which conversations end."""
    ended = rows.where("ends").select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha = None

        def made(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([d[0][i] for d in done], type=pa.int64()) for i in range(3)],
                 pa.array([d[1] for d in done], type=pa.string())], names=[*KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for *at, conv in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if at == key:
                    sha.update(b",%d" % conv)
                    continue
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = at, hashlib.sha256(b"%d" % conv)
            if done:
                yield made(done)
        if key is not None:
            yield made([(key, sha.hexdigest())])

    return ended.mapInArrow(run, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", salt: int = 1, attempts: int = 8) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(conversations.sparkSession)
    empty = F.lit("")
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    for salt in range(salt, salt + attempts):
        stored = materialize(_stored_turns(turns, salt), "turns")
        prefixes = materialize(_prefixes(stored, salt), "prefixes")
        plans = materialize(_plans(prefixes), "plans")
        rows = materialize(_rebuilt(prefixes, plans, salt), "rebuilt")
        nodes = materialize(_nodes(rows), "nodes")
        if _verified(nodes, rows, stored):
            break
    else:
        raise RuntimeError("fingerprints met in every attempt")

    parent_key = [(F.col("depth") - 1).alias("depth"), F.col("p1_min").alias("f1"), F.col("p2_min").alias("f2")]
    kids = nodes.where("depth > 0").groupBy(*parent_key).agg(F.count(F.lit(1)).alias("n_children"))
    tops = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1_min"), F.col("f2").alias("p2_min"),
                        F.col("conv_id").alias("parent_conv_id"))
    tree = materialize(
        nodes.select(*KEY, "p1_min", "p2_min", "conv_id", "n_convs", "before").join(kids, KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .join(tops, ["depth", "p1_min", "p2_min"], "left"), "trie")
    # a conversation's chain of owned nodes: the bytes above it, and whether a childless node ends it
    chains = tree.groupBy("conv_id").agg(F.min_by("before", "depth").alias("above"),
                                         F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    zero = F.lit(0).cast("long")
    members = plans.select("conv_id", "total").join(chains, "conv_id", "left").select(
        "conv_id", "total", F.coalesce(F.col("total") - F.col("above"), zero).alias("chain"),
        F.coalesce("leaf", zero).alias("leaf"))
    sums = rows.select("conv_id", *KEY).join(members, "conv_id").groupBy(*KEY).agg(
        F.sum("leaf").alias("n_leaves"), F.sum("total").alias("sum_total"), F.sum("chain").alias("sum_chain"),
        F.min_by("total", "conv_id").alias("owner_total"), F.min_by("chain", "conv_id").alias("owner_chain"))
    subtree = F.col("sum_chain") - F.col("owner_chain") + F.col("owner_total") - F.col("before")
    return (tree.join(sums, KEY).join(_digests(rows), KEY, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    (F.col("sum_total") - F.col("n_convs") * F.col("before") - subtree).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))
