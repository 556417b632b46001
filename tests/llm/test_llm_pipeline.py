"""The pipeline at sf0.001 and over odd rows: columns, effects of each stage, and plain forms."""

import corpus_pipeline as P
from conftest import SF_SMALL
from featuremart.llm import op2_langid, op3_jaccard_join, op4_packing, op6_quality
from test_llm_operators import EXTRA, ODD, brute_removed


def test_stages_against_plain_forms(spark):
    docs = P.read_table(spark, SF_SMALL, "documents")
    labels = P.read_table(spark, SF_SMALL, "labels")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "suffix-array dedup",
                                        "best-fit packing"]
    made = [docs]
    for name, stage in P.STAGES:
        made.append(P.materialize(stage(spark, made[-1], SF_SMALL), "test"))
    texts = [{r["doc_id"]: r["text"] for r in m.collect()} for m in made[:-1]]
    assert all(m.dtypes == docs.dtypes for m in made[:-1])
    model = op6_quality.train(docs, labels, op6_quality.train_fold)
    assert set(texts[1]) == {i for i, t in texts[0].items() if model.score(t) >= P.LEAST_QUALITY}
    lang = op2_langid.train(made[1], op2_langid.train_fold)
    ok = {i: lang.predict(t) for i, t in texts[1].items()}
    assert set(texts[2]) == {i for i, (x, s) in ok.items() if x != "und" and s >= P.LEAST_LANGUAGE}
    sets = {i: set(op3_jaccard_join.shingles(t).tolist()) for i, t in texts[2].items()}
    ids = sorted(sets)
    root = {i: i for i in ids}
    near = [(a, b) for a in ids for b in ids if a < b and (texts[2][a] == texts[2][b] or (
        sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))]
    for _ in ids:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert set(texts[3]) == {i for i in ids if root[i] == i}
    rows = sorted(texts[3].items())
    gone = brute_removed([t.encode() for _, t in rows], P.LEAST_REPEAT)
    assert texts[4] == {i: bytes(b for b, g in zip(t.encode(), x) if not g).decode("utf-8", "ignore")
                        for (i, t), x in zip(rows, gone)}
    words = {i: len(t.split()) + 1 if t.split() else 0 for i, t in texts[4].items()}
    packed = made[-1].collect()
    for i, n in words.items():
        assert sum(r["n_tokens"] for r in packed if r["doc_id"] == i) == n
    assert all(r["bin_used"] <= r["bin_length"] <= op4_packing.LENGTHS[-1] for r in packed if r["bin_id"])


def test_stages_survive_odd_and_empty_documents(spark):
    odd = spark.createDataFrame([(i, t, None if i is None else "xy"[i % 2], "k", 1, "s", "p", 3, len(t or "")) for i, t in ODD],
                                EXTRA)
    for start in (odd, odd.limit(0)):
        docs = start
        for name, stage in P.STAGES:
            docs = P.materialize(stage(spark, docs, SF_SMALL), "odd")
            if name != "best-fit packing":
                assert docs.columns == odd.columns
        assert docs.count() == 0 or start is odd


def test_run(spark):
    got = P.run(spark, SF_SMALL)
    assert got.count() > 0 and "bin_id" in got.columns
