"""Plan-shape checks for the scale claims in the README."""

from pyspark.sql import functions as F

from feedpulse.operators import broadcast as B
from feedpulse.operators import fetch as FE


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_per_key_prunes_before_shuffle(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = FE.top_n_per_key(df, ["k"], [F.col("v").desc()], 5)
    assert out.count() == 15
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in _plan(out)


def test_size_checked_broadcast(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert B.bounded_rows(small, 100) == 10
    assert B.bounded_rows(big, 100) is None
    j = spark.range(5000).join(B.maybe_broadcast(small, 100), "id")
    assert "BroadcastHashJoin" in _plan(j)
    # above the bound no hint is added: the planner / AQE decide
    assert B.maybe_broadcast(big, 100) is big


def test_lexicon_plan_in_the_row(spark):
    from tests.conftest import SF_SMALL
    from feedpulse.operators import lexicon as L
    from feedpulse.plans.q_models import m1_scores
    from feedpulse.sources import adapters as A
    p = _plan(m1_scores(spark, SF_SMALL))
    assert "Generate" not in p and "Join" not in p and "hashpartitioning" not in p
    # a lexicon over the byte limit: joined, with one shuffle of sums by document
    p = _plan(L.lexicon_score(A.content(spark, SF_SMALL), L.default_lexicon(spark), max_packed_bytes=0))
    assert "BroadcastHashJoin" in p and "Generate" in p
    assert "SortMergeJoin" not in p
