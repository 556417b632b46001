"""Prefix trie, spelling variants and graph search against brute-force forms, odd rows included."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from featuremart.llm import op11_prefix_trie, op12_spelling, op13_graph_search

# -- prefix trie -------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, f1 long, length int, head string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + turns[h:]
        ends[tuple(seq)].append(c)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got_trie(df):
    return sorted((tuple(r) for r in op11_prefix_trie.trie(df).collect()), key=lambda r: r[:2])


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "h") for r in rows], TURNS)


def test_trie_of_odd_conversations(spark):
    long = "word é " * 50_000
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3}") for c in range(40) for t in range(c % 13)]
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(9)]          # copies
    rows += [(200, t, "user", f"hot {t % 7}") for t in range(150)]                       # a hot conversation
    rows += [(201, t, "user", f"hot {t % 7}") for t in range(140)]
    rows += [(300, None, "user", "b"), (300, None, "user", "a"), (300, 1, None, None), (300, 1, None, None), (300, 0, "", long)]
    rows += [(305, 3, "system", long), (None, 1, "user", "no conversation"), (None, None, None, None), (7, 99, None, "x")]
    assert got_trie(turns_of(spark, rows)) == plain_trie(rows)


def test_trie_splits_a_conversation_over_tasks(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (10, 11, 12) for t in range(100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _split(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _split(spark, rows):
    stored = op11_prefix_trie._stored_turns(turns_of(spark, rows).select("conv_id", "turn", "role", "text"), 1)
    assert stored.groupBy("conv_id").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] > 1
    assert got_trie(turns_of(spark, rows)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert got_trie(turns_of(spark, [])) == []
    assert got_trie(turns_of(spark, [(None, 1, "a", "b")])) == []


def test_trie_turnless_rebuilt(spark):
    # 4 has more head turns to take than its base holds, and none of its own left
    c = next(i for i in range(1, 1000) if i % 5 and zlib.crc32(str(i).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert got_trie(turns_of(spark, rows)) == plain_trie(rows)
    assert [r[:6] for r in got_trie(turns_of(spark, rows))] == [(c, 0, None, 1, 0, 1)]


def test_products():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, op11_prefix_trie.P, 1000, dtype=np.uint64) for _ in range(2))
    p = op11_prefix_trie.P
    assert op11_prefix_trie.mul(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist())]
    assert op11_prefix_trie.sub(a, b).tolist() == [(x - y) % p for x, y in zip(a.tolist(), b.tolist())]
    assert op11_prefix_trie.running(a).tolist() == [sum(a.tolist()[:i + 1]) % p for i in range(1000)]
    w = op11_prefix_trie.Powers(1, 0)
    assert w(np.array([0, -3, 9000])).tolist() == [1, pow(w.base, -3, p), pow(w.base, 9000, p)]


def test_trie_on_the_table(spark):
    t = spark.read.parquet(f"{SF_CHECK}/conversations.parquet")
    assert got_trie(t) == plain_trie([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])


def test_false_meetings_are_found(spark):
    """Two different turns behind one node are seen, so the run would be repeated."""
    stored = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "ref long, role string, text string")
    one = [(7, 1, 5, 5, 0, 0, 1), (8, 1, 5, 5, 0, 0, 2)]
    rows = spark.createDataFrame([(*r, 1, 1, True) for r in one],
                                 "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, ref long, bytes long, own_bytes long, ends boolean")
    assert not op11_prefix_trie._verified(op11_prefix_trie._nodes(rows), rows, stored)
    assert op11_prefix_trie._verified(op11_prefix_trie._nodes(rows), rows, stored.withColumn("text", F.lit("a")))
    apart = rows.withColumn("p1", F.col("conv_id"))
    assert not op11_prefix_trie._verified(op11_prefix_trie._nodes(apart), apart, stored.withColumn("text", F.lit("a")))


# -- spelling variants ---------------------------------------------------------------------------------

def plain_words(docs):
    upper = {c: c + 32 for c in range(65, 91)}
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    letters = sorted({c for w in words for c in w})
    form, out = {}, []
    for w, n in words.items():
        near = {w[:i] + w[i + 1:] for i in range(len(w))}
        for i in range(len(w) + 1):
            near |= {w[:i] + c + w[i:] for c in letters} | {w[:i] + c + w[i + 1:] for c in letters}
        near = [x for x in near if x in words and x != w]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = (best if best and words[best] >= 2 * n else None, len(near))
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][1], words[form[w][0]] if form[w][0] else None))
    return sorted(out, key=lambda r: r[0])


def got_variants(df):
    return sorted((tuple(r) for r in op12_spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()),
                  key=lambda r: r[0])


DOCS = "doc_id long, text string, word string, n int, id long, prefixes string"


def test_variants_of_odd_texts(spark):
    base = ["colour"] * 40 + ["color"] * 90 + ["colours"] * 15 + ["colorr", "coolor", "aaaaa", "aaaaaa", "aaaaaaa"] * 3
    base += ["École", "école", "ECOLE"] * 4 + ["größe", "grösse", "große"] * 5 + ["×÷×÷×", "×÷×÷÷"] * 3 + ["中文中文中"] * 5
    huge = " ".join(["stretch" * 200_000] * 3)  # runs longer than a piece
    docs = [(i, " ".join(base[i % 7:]) + f" tail{i}") for i in range(30)]
    docs += [(31, None), (32, ""), (33, "a b c"), (None, "colour colour"), (None, None), (5, docs[5][1]), (34, huge),
             (35, "x" * 3000 + " " + "x" * 2999 + " ") , (36, ("x" * 3000 + " ") * 3 + ("x" * 2999 + "-") * 7)]
    df = spark.createDataFrame([(*d, "w", 1, 2, "p") for d in docs], DOCS)
    words = plain_words(docs)
    got = got_variants(df)
    assert {r[0]: r[3] for r in got} == words
    short = {w: n for w, n in words.items() if len(w) < 100}
    assert [r for r in got if len(r[0]) < 100] == plain_variants(short)
    near = {r[0]: (r[1], r[4]) for r in got if 100 <= len(r[0]) < 4000}
    assert near["x" * 3000][1] >= 1 and near["x" * 2999][1] >= 1  # at one edit, in 3,000 places


def test_variants_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert got_variants(docs) == plain_variants(plain_words([tuple(r) for r in docs.collect()]))


def test_variants_of_nothing(spark):
    assert got_variants(spark.createDataFrame([], DOCS)) == []
    assert got_variants(spark.createDataFrame([(1, None, "w", 1, 2, "p")], DOCS)) == []


def test_pieces_cut_no_run(monkeypatch):
    monkeypatch.setattr(op12_spelling, "PIECE", 10)
    text = "alpha beta gamma, " * 20 + "z" * 35 + " omega"
    assert "".join(op12_spelling.pieces(text)) == text
    whole = re.findall("[a-z]{5,}", text)
    assert [w for p in op12_spelling.pieces(text) for w in re.findall("[a-z]{5,}", p)] == whole


def test_node_numbers_name_prefixes(spark):
    words = sorted({"".join(np.random.default_rng(i).choice(list("abé"), 1 + i % 9)) for i in range(400)} | {"a" * 200, "a" * 199 + "b"})
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r["w"]: r["nodes"] for r in op12_spelling.number_nodes(df, "w", "nodes").collect()}
    names = {}
    for w in words:
        assert len(got[w]) == len(w) + 1
        for i, node in enumerate(got[w]):
            assert names.setdefault(node, w[:i]) == w[:i]
    assert len(names) == len({w[:i] for w in words for i in range(len(w) + 1)})
    assert [got[w][-1] for w in words] == sorted(got[w][-1] for w in words)  # in the words' order


# -- graph search --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, row long, dim string, k1 long"


def product(x, y):
    total = 0.0  # one by one: Python's sum corrects its rounding
    for a, b in zip(x.tolist(), y.tolist()):
        total += a * b
    return total


def exact(rows, k=20):
    """{query row: [(score, id)]}, its best ``k``."""
    ok = [(i, v, np.array(x)) for i, (v, x) in enumerate(rows)
          if x and all(c is not None and np.isfinite(c) for c in x) and any(c != 0 for c in x)]
    out = {}
    for i, v, x in ok:
        if v is None or v % 20:
            continue
        found = sorted(((-product(x, y), w is None, w or 0) for j, w, y in ok
                        if j != i and len(y) == len(x)))[:k]
        out[i] = [(v, -s, None if null else w) for s, null, w in found]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(v, None if x is None else [None if c is None else float(c) for c in x], 1, 2, "d", 3)
                                  for v, x in rows], VECTORS)


def found(df, **kw):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op13_graph_search.neighbours(df, **kw).collect()]


def test_search_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(i, [1.0, 0, 0, 0, 0, 0]) for i in range(100, 160)]                          # copies
    rows += [(500, [0.0] * 6), (520, None), (540, []), (560, [1.0, None, 2.0]), (580, [float("nan")] * 6),
             (600, [float("inf"), 1.0]), (None, [1.0, 0, 0, 0, 0, 0]), (620, [1.0, 2.0]), (640, [2.0, 1.0]), (20, [3.0, 1.0]),
             (20, [3.0, 1.0]), (660, [1e200] * 3), (680, [1e-200] * 3)]
    got = defaultdict(list)
    for q, rank, v, s in found(vectors_of(spark, rows)):
        got[q].append((rank, v, s))
    want = defaultdict(list)
    for listed in exact(rows).values():
        for rank, (q, s, v) in enumerate(listed, 1):
            want[q].append((rank, v, s))
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert {q: sorted(x, key=key) for q, x in got.items()} == {q: sorted(x, key=key) for q, x in want.items()}


def test_search_of_nothing(spark):
    assert found(vectors_of(spark, [])) == []
    assert found(vectors_of(spark, [(20, [1.0, 2.0])])) == []
    assert found(vectors_of(spark, [(20, None), (40, [0.0])])) == []


@pytest.mark.parametrize("spread", ["unit", "lengths", "clusters"])
def test_search_recall(spark, spread):
    """Recall over several shards against brute force; lists are complete, ranked and exactly scored."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 24))
    if spread == "clusters":
        x = x[rng.integers(0, 12, 3000)] + 0.05 * rng.standard_normal((3000, 24))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    if spread == "lengths":
        x *= rng.lognormal(0, 0.5, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(dict)
    for q, rank, v, s in found(vectors_of(spark, rows), shard=700):
        got[q][rank] = (v, s)
        assert s == pytest.approx(float(x[q] @ x[v]), abs=1e-12)
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert sorted(got[q]) == list(range(1, 21)) and len({v for v, _ in got[q].values()}) == 20
        assert [got[q][r][1] for r in range(1, 21)] == sorted((t for _, t in got[q].values()), reverse=True)
        hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & {v for v, _ in got[q].values()})
    assert hits / 3000 >= 0.95


def test_search_on_the_table(spark):
    t = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").select("vec_id", "embedding")
    want = exact([tuple(r) for r in t.collect()])
    got = found(t)
    assert len(got) == sum(map(len, want.values()))
    assert {(q, v) for q, _, v, _ in got} == {(q, v) for x in want.values() for q, _, v in x}
