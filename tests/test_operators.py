"""Relational operators: stack-and-sum, semi-join restriction, ranked head, size-checked broadcast."""

import contextlib
import io
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from featuremart.operators import bounded_broadcast, ranked_head, restrict_to, stack_and_sum


def test_stack_and_sum_pads_zero_and_groups_null_keys(spark):
    a = spark.createDataFrame([("k1", 2, 1.5), (None, 1, None), ("k2", 0, None)], "k string, x bigint, p double")
    b = spark.createDataFrame([("k1", 10), (None, 5), ("k3", 7)], "k string, y bigint")
    got = rows(stack_and_sum([a, b], ["k"], ["x", "y", "p"]))
    # NULL price becomes 0 only where another frame holds the key (k1 keeps 1.5, k2 stays NULL)
    assert got == [("k1", 2, 10, 1.5), ("k2", 0, 0, None), ("k3", 0, 7, 0.0), (None, 1, 5, 0.0)]


def test_stack_and_sum_requires_every_measure(spark):
    a = spark.createDataFrame([("k", 1)], "k string, x bigint")
    with pytest.raises(ValueError):
        stack_and_sum([a], ["k"], ["x", "y"])


def test_restrict_to_never_multiplies_rows(spark):
    facts = spark.createDataFrame([("1", 1), ("1", 2), ("2", 3), ("3", 4), (None, 5)], "g string, v int")
    goods = spark.createDataFrame([("1",), ("1",), ("1",), ("2",), (None,)], "gds_cd string")
    for side in (goods, bounded_broadcast(goods, 10), bounded_broadcast(goods, 2)):
        assert rows(restrict_to(facts, side, "g", "gds_cd")) == [("1", 1), ("1", 2), ("2", 3)]


def _physical(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_bounded_broadcast_respects_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only the explicit hint may broadcast
    try:
        facts = spark.range(10 ** 5).withColumn("k", F.col("id") % 1000)
        dim = spark.range(100).withColumnRenamed("id", "k")
        within = facts.join(bounded_broadcast(dim, 100), "k", "left_semi")
        beyond = facts.join(bounded_broadcast(dim, 99), "k", "left_semi")
        assert "BroadcastHashJoin" in _physical(within)
        assert "BroadcastHashJoin" not in _physical(beyond)
        assert within.count() == beyond.count() == 10 ** 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("dense", [False, True])
def test_ranked_head_equals_global_window(spark, dense):
    rnd = random.Random(3)
    data = [(i, rnd.randint(0, 8), rnd.randint(0, 5) if rnd.random() > 0.1 else None) for i in range(400)]
    df = spark.createDataFrame(data, "id int, a int, b int").repartition(7)
    w = Window.orderBy(F.col("a").desc(), F.col("b").desc())
    fn = F.dense_rank() if dense else F.rank()
    for k in (1, 2, 5, 30, 1000):
        expected = rows(df.withColumn("rank", fn.over(w)).where(F.col("rank") < k))
        got = rows(ranked_head(df, ["a", "b"], k, dense=dense))
        assert got == expected, k


def test_key_bits_cut_the_facts_before_the_shuffle(spark):
    from featuremart.operators.joins import key_bits, reduce_by_bits
    goods = spark.range(0, 40_000, 20).select(F.col("id").cast("string").alias("gds_cd"))
    facts = spark.range(200_000).select(F.when(F.col("id") % 1000 != 7, (F.col("id") % 50_000).cast("string")).alias("g"),
                                        F.col("id").alias("w0"))
    bits = key_bits(goods, "gds_cd")
    size = bits.agg(F.max("size")).first()[0]
    kept = reduce_by_bits(facts, "g", bits, size)
    matches = facts.join(goods, F.col("g") == F.col("gds_cd"), "left_semi")
    assert kept.columns == facts.columns
    assert rows(restrict_to(kept, goods, "g", "gds_cd")) == rows(matches)
    assert matches.count() <= kept.count() < matches.count() + 0.03 * facts.count()
    assert reduce_by_bits(facts, "g", key_bits(goods.limit(0), "gds_cd"), 1 << 16).count() == 0


def test_jobs_beyond_the_broadcast_bound(spark):
    """The jobs give the same with a shuffled product list, whose facts are cut by its bit table."""
    from conftest import SF_SMALL
    from featuremart.plans import sales, visits
    from featuremart.queries import DAY
    from featuremart.sources import SourceTables
    near, far = (SourceTables.from_testdata(spark, SF_SMALL, goods_broadcast_rows=n) for n in (2_000_000, 0))
    for job in (sales.sales_features, visits.gds_visit):
        assert rows(job(far, DAY)) == rows(job(near, DAY))
    plan = sales.sales_base(far, DAY)._jdf.queryExecution().executedPlan().toString()
    assert "key-bits" in plan and plan.index("LeftSemi") < plan.index("key-bits")  # below the semi join
