"""Scalar, table and aggregate functions: the reference's own unit tests and documented examples,
plus hand-made edge rows (NULLs, blanks, ties, empty groups, odd flags)."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from featuremart.functions import (array_contains_strict, greeting, letters_total, max_any, max_min, median_by,
                                   register_functions, total_score)
from featuremart.functions.expr import day_key_by_parsing, day_key_from_text
from featuremart.operators import dau_count, name_rows, topn_array, topn_rows


# ---- greeting (reference unit test: value and NULL) ------------------------------------------------
def test_greeting(spark):
    df = spark.createDataFrame([("world",), (None,)], "t string")
    assert [r.g for r in df.select(greeting(F.col("t")).alias("g")).collect()] == ["Hello world", None]


# ---- array contains (reference unit test: present, absent, NULLs) -------------------------------
def test_array_contains_reference_cases(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "a"), (["a", "b", "c"], "d"), (None, None)],
                               "arr array<string>, x string")
    got = [r.c for r in df.select(array_contains_strict(F.col("arr"), F.col("x")).alias("c")).collect()]
    assert got == [True, False, None]


def test_array_contains_null_element_is_false_not_null(spark):
    df = spark.createDataFrame([(["a", None], "b"), (["a", None], "a"), (["a"], None)], "arr array<string>, x string")
    got = [r.c for r in df.select(array_contains_strict(F.col("arr"), F.col("x")).alias("c")).collect()]
    assert got == [False, True, None]


# ---- total score (documented example) ---------------------------------------------------------------
def test_total_score_documented_example(spark):
    df = spark.createDataFrame([
        ("A", [{"math": 100, "english": 90, "history": 85}]),
        ("B", [{"math": 95, "english": 80, "history": 100}]),
        ("C", [{"math": 80, "english": 90, "histroy": 100}]),
    ], "name string, score_list array<map<string,int>>")
    got = df.select(total_score(F.col("name"), F.col("score_list")).alias("s")).select("s.*").collect()
    assert [(r.name, r.totalScore) for r in got] == [("A", 275), ("B", 275), ("C", 270)]


def test_total_score_two_maps_and_nulls(spark):
    df = spark.createDataFrame([
        ("two", [{"a": 1, "b": 2}, {"c": 10}]),
        ("nullval", [{"a": None, "b": 5}]),
        ("nulllist", None),
        (None, [{"a": 1}]),
    ], "name string, score_list array<map<string,int>>")
    got = df.select(total_score(F.col("name"), F.col("score_list")).alias("s")).select("s.*").collect()
    assert [(r.name, r.totalScore) for r in got] == [("two", 13), ("nullval", 5), ("nulllist", 0), (None, 1)]


# ---- name rows (reference unit tests + blanks / case) ------------------------------------------------
NAMES = [(1, "Smith"), (2, "John Smith"), (3, "John and Ann White"), (4, "Blah Blah Blah Blah"), (5, None),
         (6, " Smith"), (7, "   "), (8, "John AND Ann White"), (9, ""), (10, "John Smith  "),
         (11, "John\tSmith")]


def test_name_rows(spark):
    df = spark.createDataFrame(NAMES, "id int, n string")
    got = rows(name_rows(df, "n", keep=["id"]))
    assert got == sorted([(2, "John", "Smith"), (3, "John", "White"), (3, "Ann", "White"), (6, "", "Smith"),
                          (10, "John", "Smith"), (11, "John", "Smith")],
                         key=lambda r: tuple((x is None, str(x)) for x in r))


def test_name_rows_sql_table_function_matches(spark):
    register_functions(spark)
    spark.createDataFrame(NAMES, "id int, n string").createOrReplaceTempView("names_t")
    via_sql = rows(spark.sql("SELECT t.id, r.name, r.surname FROM names_t t, LATERAL name_rows(t.n) r"))
    via_df = rows(name_rows(spark.table("names_t"), "n", keep=["id"]))
    assert via_sql == via_df
    assert rows(spark.sql("SELECT * FROM name_rows('Smith')")) == []


def test_sql_scalar_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT greeting('world') g, greeting(NULL) gn, array_contains_strict(array('a', NULL), 'b') c, "
                  "total_score('A', array(map('m', 100, 'e', 90, 'h', 85))).totalScore s").collect()[0]
    assert (r.g, r.gn, r.c, r.s) == ("Hello world", None, False, 275)


# ---- day keys -----------------------------------------------------------------------------------------
def test_day_keys_malformed_give_null(spark):
    df = spark.createDataFrame([("2024-01-15 12:00:00",), ("-",), (None,), ("2024-13-45 00:00:00",)], "t string")
    got = df.select(day_key_from_text(F.col("t")).alias("a"), day_key_by_parsing(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("20240115", "20240115"), ("", None), (None, None), ("20241345", None)]


# ---- max / max_min ----------------------------------------------------------------------------------
def test_max_any_types_and_empty(spark):
    df = spark.createDataFrame([(1, -5, "b", -1.5), (1, -3, "a", -2.5), (2, None, None, None)],
                               "g int, i int, s string, d double")
    got = rows(df.groupBy("g").agg(max_any(df, "i").alias("i"), max_any(df, "s").alias("s"),
                                   max_any(df, "d").alias("d")))
    assert got == [(1, -3, "b", -1.5), (2, None, None, None)]
    mdf = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    with pytest.raises(TypeError):
        max_any(mdf, "m")


def test_max_min_all_negative_strings_and_empty(spark):
    df = spark.createDataFrame([(1, "-5"), (1, "-3.5"), (1, "x"), (2, None), (3, "1e10")], "g int, v string")
    got = rows(df.groupBy("g").agg(*max_min(df, "v", "mm")))
    assert got == [(1, -3.5, -5.0, "-3.5\t-5.0"), (2, None, None, None), (3, 1e10, 1e10, "1.0E10\t1.0E10")]
    bdf = spark.createDataFrame([(True,)], "b boolean")
    with pytest.raises(TypeError):
        max_min(bdf, "b")


# ---- median -------------------------------------------------------------------------------------------
def test_median_odd_even_null_and_types(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 4), (2, 1), (3, None), (4, 2147483647), (4, 2147483647)],
                               "g int, x int")
    got = rows(median_by(df, ["g"], "x"))
    assert got == [(1, 2.0), (2, 2.5), (3, None), (4, 2147483647.0)]  # all-NULL group 3: NULL; no int overflow
    sdf = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(TypeError):
        median_by(sdf, [], "s")


@pytest.mark.parametrize("parts,salts", [(1, 32), (4, 32), (64, 32), (4, 1)])
def test_median_matches_brute_force_on_skewed_group(spark, parts, salts):
    import random
    rnd = random.Random(7)
    data = [(0, rnd.random() * 1000) for _ in range(3000)] + [(g, float(rnd.randint(0, 50))) for g in range(1, 30)
                                                             for _ in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(data, "g int, x double").repartition(parts)
    got = dict((g, m) for g, m in median_by(df, ["g"], "x", salts=salts).collect())
    by = {}
    for g, x in data:
        by.setdefault(g, []).append(x)
    for g, xs in by.items():
        xs.sort()
        n = len(xs)
        exp = (xs[(n - 1) // 2] + xs[n // 2]) / 2
        assert got[g] == pytest.approx(exp, abs=1e-9), g


def test_ordered_key_orders_every_double(spark):
    import math
    import random
    import struct
    from pyspark.sql import functions as F
    from featuremart.functions.aggs import ordered_key
    rnd = random.Random(5)
    xs = [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(1000)]
    xs = [x for x in xs if x == x] + [0.0, 5e-324, -5e-324, 1.7976931348623157e308, math.inf, -math.inf]
    xs += [2.0 ** k for k in range(-1074, 1024, 3)] + [math.nextafter(2.0 ** k, 0) for k in range(-1022, 1024, 3)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_key(F.col("x")).alias("k")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.k)] == sorted(xs)
    assert len({r.k for r in got}) == len(set(xs))


@pytest.mark.parametrize("kind", ["int", "bigint", "double"])
def test_median_of_extreme_values_and_without_groups(spark, kind):
    top = {"int": 2 ** 31 - 1, "bigint": 2 ** 62, "double": 1e300}[kind]
    vals = [top, -top, 0, 1, -1, 7, 7, 65536, -65537, top - 1]
    vals = [float(v) for v in vals] if kind == "double" else vals
    for k in range(1, len(vals) + 1):
        xs = sorted(vals[:k])
        df = spark.createDataFrame([(v,) for v in vals[:k]], f"x {kind}")
        if k in (1, 2, 5, 10):
            assert rows(median_by(df, [], "x")) == [((float(xs[(k - 1) // 2]) + float(xs[k // 2])) / 2,)]
    empty = spark.createDataFrame([], f"x {kind}")
    assert rows(median_by(empty, [], "x")) == [(None,)] and rows(median_by(empty.selectExpr("1 AS g", "x"), ["g"], "x")) == []


# ---- letters ------------------------------------------------------------------------------------------
def test_letters_total_counts_characters(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, None), (1, "日本"), (2, None)], "g int, t string")
    got = rows(df.groupBy("g").agg(letters_total(df, "t").alias("n")))
    assert got == [(1, 6), (2, 0)]
    assert df.where("false").agg(letters_total(df, "t").alias("n")).collect()[0].n == 0


# ---- top-n --------------------------------------------------------------------------------------------
TOPN_DATA = [("a", 5.0, 1), ("a", 9.0, 2), ("a", 9.0, 1), ("a", None, 3), ("a", 1.0, 4), ("b", 2.0, 1)]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_topn_rows_ties_nulls_and_partitioning(spark, parts):
    df = spark.createDataFrame(TOPN_DATA, "g string, k double, p int").repartition(parts)
    got = rows(topn_rows(df, ["g"], 3, "k", ["p"]))
    assert got == [("a", 5.0, 1, 3), ("a", 9.0, 1, 1), ("a", 9.0, 2, 2), ("b", 2.0, 1, 1)]


def test_topn_array_padded(spark):
    df = spark.createDataFrame(TOPN_DATA, "g string, k double, p int")
    got = {r.g: [tuple(x) if x is not None else None for x in r.topn] for r in topn_array(df, ["g"], 3, "k", ["p"])
           .collect()}
    assert got["a"] == [(9.0, 1), (9.0, 2), (5.0, 1)]
    assert got["b"] == [(2.0, 1), (None, None), (None, None)]


def test_topn_rejects_bad_n(spark):
    df = spark.createDataFrame(TOPN_DATA, "g string, k double, p int")
    with pytest.raises(ValueError):
        topn_rows(df, ["g"], 0, "k")


# ---- DAU ----------------------------------------------------------------------------------------------
def test_dau_documented_example_rule_gives_3(spark):
    df = spark.createDataFrame([(1, "uid1", "imei1"), (1, "uid2", "imei1"), (0, "uid3", "imei3")],
                               "flag int, uid string, imei string").withColumn("d", F.lit("x"))
    assert dau_count(df, ["d"]).collect()[0].dau == 3


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_dau_odd_flags_and_nulls(spark, parts):
    data = [
        (1, "u1", "i1"), (0, None, "i1"),       # i1 seen logged in and anonymous -> only u1
        (2, None, "i2"),                         # flag 2 is "not 1": anonymous only
        (3, None, "i3"), (1, "u3", "i3"),        # flag 3 then 1: both
        (None, "u9", "i9"),                      # NULL flag ignored
        (1, None, "i4"),                         # logged in without uid: no user, device not anonymous
        (0, None, None),                         # anonymous without device: nothing
        (1, "u1", None),                         # same user again
    ]
    df = spark.createDataFrame(data, "flag int, uid string, imei string").withColumn("d", F.lit("x")).repartition(parts)
    # logged users {u1, u3} + anonymous-only devices {i2} = 3
    assert dau_count(df, ["d"]).collect()[0].dau == 3


def test_dau_rejects_non_integer_flag(spark):
    df = spark.createDataFrame([("1", "u", "i", "x")], "flag string, uid string, imei string, d string")
    with pytest.raises(TypeError):
        dau_count(df, ["d"])


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_letters_and_max_min_do_not_depend_on_partitioning(spark, parts):
    data = [(g, t, v) for g in range(5) for t, v in [("abc", "-1.5"), (None, "x"), ("日本語", "2"), ("", None)]]
    data += [(9, None, None)]
    df = spark.createDataFrame(data, "g int, t string, v string").repartition(parts)
    got = rows(df.groupBy("g").agg(letters_total(df, "t").alias("n"), *max_min(df, "v", "mm")[:2]))
    assert got == [(g, 6, 2.0, -1.5) for g in range(5)] + [(9, 0, None, None)]


# ---- argument checks (U11) ----------------------------------------------------------------------------
def test_arguments_are_checked_when_bound(spark):
    from featuremart.functions.checks import require_array_contains
    from featuremart.operators.relops import dau_count, name_rows
    df = spark.createDataFrame([(["a"], "a", 1, [1])], "arr array<string>, s string, i int, nums array<int>")
    require_array_contains(df, "arr", "s")
    for arr, x in (("nums", "s"), ("s", "s"), ("arr", "i")):
        with pytest.raises(TypeError):
            require_array_contains(df, arr, x)
    with pytest.raises(TypeError):
        name_rows(df, "i")
    for args in ({"uid": "i", "imei": "s"}, {"uid": "s", "imei": "i"}):
        with pytest.raises(TypeError):
            dau_count(df, [], flag="i", **args)


# ---- fixed values, stated literally (the oracle shares the jobs' constants) -----------------------------
def test_codes_and_labels_have_their_literal_values():
    from featuremart.plans import clct_cart, members, sales, visits
    assert clct_cart.WEB_FAVOURITE_P1 == ["shoucang01", "basic"] and clct_cart.WEB_FAVOURITE_P2 == ["gmq", "favorite"]
    assert clct_cart.WEB_CART_P1 == ["buy01", "buy03"] and clct_cart.WEB_CART_P2 == ["gmq", "tab"]
    assert clct_cart.APP_FAVOURITE_CODES == ["121316", "780801", "1010106", "1010202", "1010301", "1200220", "1210135"]
    assert clct_cart.APP_CART_CODES == ["121312", "1210138", "1210709"]
    assert dict(members.LEVEL_COLUMNS) == {"new": "161000000100", "v1": "161000000110", "v2": "161000000120",
                                           "v3": "161000000130", "orther": "-"}
    assert [label for _, label in members.AGE_COLUMNS] == [
        "40岁-49岁", "19岁-24岁", "18岁以下", "-", "35岁-39岁", "50岁-59岁", "34岁-39岁", "25岁-29岁", "60岁以上"]
    assert sales.ORDER_BUSINESS_TYPES == ["Z", "-"] and sales.PROMOTION_DEAL_TYPES == ["02", "03"]
    assert visits.VISIT_BUSINESS_TYPES == ["Z-SHIP", "-"]
