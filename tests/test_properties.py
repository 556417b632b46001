"""Randomised checks against direct Python statements of the contracts (many cases per Spark job)."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from featuremart.operators import dau_count, name_rows, topn_rows

WORDS = ["John", "Ann", "and", "AND", "Smith", "", " ", "  ", "\t", "x"]


def name_rule(name):
    """The name-rows contract: trailing blanks ignored, split on runs of whitespace."""
    if name is None or name == "":
        return []
    tokens = re.split(r"\s+", re.sub(r"\s+$", "", name))
    if len(tokens) == 2:
        return [(tokens[0], tokens[1])]
    if len(tokens) == 4 and tokens[1] == "and":
        return [(tokens[0], tokens[3]), (tokens[2], tokens[3])]
    return []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(WORDS), max_size=6).map("".join),
                          st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join)), min_size=1, max_size=200))
def test_name_rows_property(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "id int, n string")
    expected = sorted([(i, a, b) for i, n in enumerate(names) for a, b in name_rule(n)],
                      key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(name_rows(df, "n", keep=["id"])) == expected


def dau_rule(data):
    out = {}
    for g in {r[0] for r in data}:
        part = [r for r in data if r[0] == g and r[1] is not None]
        logged = {u for _, f, u, _ in part if f == 1 and u is not None}
        anon = {i for _, f, _, i in part if f != 1 and i is not None}
        seen_logged = {i for _, f, _, i in part if f == 1 and i is not None}
        out[g] = len(logged) + len(anon - seen_logged)
    return out


def test_dau_property(spark):
    rnd = random.Random(11)
    pick = lambda xs: rnd.choice(xs)
    data = [(pick(["d1", "d2", "d3"]), pick([None, 0, 1, 1, 2, 3]), pick([None, "u1", "u2", "u3", "u4"]),
             pick([None, "i1", "i2", "i3", "i4", "i5"])) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, flag int, uid string, imei string").repartition(16)
    got = {r.g: r.dau for r in dau_count(df, ["g"]).collect()}
    expected = {g: v for g, v in dau_rule(data).items()}
    assert got == expected


def test_topn_property(spark):
    rnd = random.Random(5)
    data = [(rnd.randint(0, 20), rnd.choice([None, float(rnd.randint(0, 30))]), rnd.randint(0, 9), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "g int, k double, p int, q int").repartition(32)
    got = rows(topn_rows(df, ["g"], 4, "k", ["p", "q"]))
    expected = []
    for g in sorted({r[0] for r in data}):
        grp = sorted((r for r in data if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2], r[3]))
        expected += [(g, r[1], r[2], r[3], i + 1) for i, r in enumerate(grp[:4])]
    assert got == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert df.where(F.col("k").isNull()).count() > 0


def test_stack_and_sum_property(spark):
    from featuremart.operators import stack_and_sum
    rnd = random.Random(23)
    keys = [None, "a", "b", "c"]
    f1 = [(rnd.choice(keys), rnd.choice([None, 1, 2, 5]), rnd.choice([None, 0.5, 1.5])) for _ in range(300)]
    f2 = [(rnd.choice(keys), rnd.choice([None, 3, 4])) for _ in range(300)]
    d1 = spark.createDataFrame(f1, "k string, x bigint, p double").repartition(7)
    d2 = spark.createDataFrame(f2, "k string, y bigint").repartition(5)
    got = {r.k: (r.x, r.y, r.p) for r in stack_and_sum([d1, d2], ["k"], ["x", "y", "p"]).collect()}

    def total(values):
        vals = [v for v in values if v is not None]
        return sum(vals) if vals else None
    expected = {}
    for k in {r[0] for r in f1} | {r[0] for r in f2}:
        # each input row contributes its own measures and 0 for the ones its frame lacks
        xs = [r[1] for r in f1 if r[0] == k] + [0 for r in f2 if r[0] == k]
        ys = [0 for r in f1 if r[0] == k] + [r[1] for r in f2 if r[0] == k]
        ps = [r[2] for r in f1 if r[0] == k] + [0.0 for r in f2 if r[0] == k]
        expected[k] = (total(xs), total(ys), total(ps))
    assert got.keys() == expected.keys()
    for k in expected:
        gx, gy, gp = got[k]
        ex, ey, ep = expected[k]
        assert (gx, gy) == (ex, ey) and (gp is None) == (ep is None) and (gp is None or abs(gp - ep) < 1e-9), k


def test_groups_without_values_stay(spark):
    from featuremart.functions import median_by
    from featuremart.operators.relops import topn_array
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, 3), ("b", None, 4)], "g string, x double, p int")
    assert rows(median_by(df, ["g"], "x")) == rows(df.groupBy("g").agg(F.median("x")))
    got = {r["g"]: [tuple(e) for e in r["topn"]] for r in topn_array(df, ["g"], 2, "x", ["p"]).collect()}
    assert got == {None: [(3.0, 2), (1.0, 1)], "a": [(5.0, 3), (None, None)], "b": [(None, None), (None, None)]}
    flags = spark.createDataFrame([("d", None, "u", "i"), ("e", 1, "u", "i")], "g string, flag int, uid string, imei string")
    assert rows(dau_count(flags, ["g"])) == [("d", 0), ("e", 1)]
