"""Seen ids across runs: same rows as the plain anti join, and no shuffle of the stored side."""

import uuid

from feedpulse.operators import fetch as FE
from feedpulse.operators.seen import SeenIds


def ids(spark, values):
    return spark.createDataFrame([(v, f"t{v}") for v in values], "id string, text string")


def got(df):
    return sorted((r.id or "", r.text) for r in df.collect())


def test_runs_see_only_new_ids(spark):
    seen = SeenIds(spark, f"seen_{uuid.uuid4().hex[:8]}", "string", buckets=4)
    first, second = ids(spark, ["a", "b", None]), ids(spark, ["b", "c", "c", None])
    assert got(seen.new(first, "r1")) == got(first)
    seen.add(first, "r1")
    # a run repeated after a failure gets its rows again, and storing them twice changes nothing
    assert got(seen.new(first, "r1")) == got(first)
    seen.add(first, "r1")
    assert got(seen.new(second, "r2")) == got(FE.new_only(second, first)) == [("", "tNone"), ("c", "tc"), ("c", "tc")]
    seen.add(second, "r2")
    assert got(seen.new(ids(spark, ["a", "b", "c", "d"]), "r3")) == [("d", "td")]
    # the table is found again by its name
    assert SeenIds(spark, seen.name, "string", buckets=4, path=seen.path).ids().select("id").distinct().count() == 3
    assert seen.new(first.limit(0), "r4").count() == 0


def test_stored_side_is_not_shuffled(spark):
    seen = SeenIds(spark, f"seen_{uuid.uuid4().hex[:8]}", "bigint", buckets=64)
    seen.add(spark.range(5000), "r1")
    seen.add(spark.range(5000, 6000), "r2")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = seen.new(spark.range(5500, 7000), "r3")
        assert out.count() == 1000
        out.write.format("noop").mode("overwrite").save()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
