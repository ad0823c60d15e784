"""Semi-join reduction and percentiles by ranges, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from feedpulse.operators import aggregate as AG
from feedpulse.operators import articles as AR
from feedpulse.operators import classify as C
from feedpulse.operators.reduction import may_match, rows_of


@pytest.mark.parametrize("wanted", [0, 1, 500])
def test_no_wanted_row_is_lost(spark, wanted):
    df = spark.range(20000).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("u"), F.col("id"))).alias("k"), F.col("id").alias("v"))
    want = spark.range(wanted).select(F.concat(F.lit("u"), F.col("id") * 30 + 1).alias("k")).union(
        spark.createDataFrame([(None,), ("absent",)], "k string"))
    left = may_match(df, want, "k")
    assert left.columns == df.columns
    exact = sorted(r.v for r in df.join(want, "k").collect())
    assert sorted(r.v for r in left.join(want, "k").collect()) == exact
    assert left.count() <= len(exact) + 20000 // 8
    # a bit set that is far too small keeps everything that is wanted
    assert sorted(r.v for r in may_match(df, want, "k", max_bits=64).join(want, "k").collect()) == exact


def test_unwanted_html_is_not_shuffled(spark):
    pages = spark.range(5000).select(F.concat(F.lit("http://h/"), F.col("id")).alias("url"), F.lit("x" * 50).alias("html"))
    entries = pages.where("url like '%7'").select(F.col("url").alias("link"))
    pages = pages.repartition(64)   # as many splits as a landed table has: no dealing out
    hits = AR.linked_pages(pages, entries)
    assert hits.columns == ["link", "html"] and 500 <= hits.count() < 1200
    joined = hits.join(entries, "link")
    assert joined.count() == 500
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan


def test_semi_join_both_ways(spark):
    # a hot key with a third of the rows, a null key, repeated wanted keys
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None)
                                  .otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    want = spark.createDataFrame([("hot",), ("k7",), ("k7",), (None,), ("none",)], "k string")
    exact = sorted(r.id for r in df.join(want, "k", "left_semi").collect())
    small, large = rows_of(df, want, "k"), rows_of(df, want, "k", max_bytes=0)
    assert sorted(r.id for r in small.collect()) == sorted(r.id for r in large.collect()) == exact
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert rows_of(df, want.limit(0), "k").count() == 0


def brute(values, share):
    values = sorted(values)
    return values[max(math.ceil(share * len(values)), 1) - 1]


def test_percentiles_by_ranges(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(3000))) for _ in range(6000)] + [("same", 5.0)] * 700 + [("one", 2.5), (None, 1.0), (None, 9.0)]
    rows += [("none", None), ("hot", None), ("neg", -1.5), ("neg", 0.0)]
    df = spark.createDataFrame(rows, "event_type string, duration_ms double")
    for parts in (1, 4, 16):
        got = {r.event_type: r for r in AG.event_percentiles(df, parts=parts).collect()}
        assert set(got) == {"hot", "same", "one", None, "neg"}
        for k, r in got.items():
            values = [v for t, v in rows if t == k and v is not None]
            assert (r.p50_ms, r.p95_ms, r.p99_ms) == tuple(brute(values, p) for p in (0.5, 0.95, 0.99)), (k, parts)
    extremes = AG.event_percentiles(df, shares={"low": 0.0, "high": 1.0})
    assert {r.event_type: (r.low, r.high) for r in extremes.collect()}["neg"] == (-1.5, 0.0)
    assert AG.event_percentiles(df.limit(0)).count() == 0


def test_source_and_model_statistics(spark):
    rows = [("a", "news", "f1", "d1", None, 1), ("b", "news", "f2", "d1", "timeout", 2), ("c", "news", "f2", "d2", "404", 2), ("d", "web", None, None, None, 9)]
    df = spark.createDataFrame(rows, "id string, source string, feed string, domain string, error string, created_at int")
    got = {r.source: r for r in AG.source_stats(df, domain_col="domain", feed_col="feed", error_col="error").collect()}
    assert tuple(got["news"]) == ("news", 3, 3, 2, 2, "404") and tuple(got["web"]) == ("web", 1, 1, 0, 0, None)
    texts = spark.createDataFrame([(i, t, "news") for i, t in enumerate(["good", "bad", " ", None])], "id long, text string, source string")
    scores = C.classifier_scores(texts, C.KeywordStubModel, keep=["source"], details=True)
    assert {r.id: r.inference_ms is not None for r in scores.collect()} == {0: True, 1: True, 2: False, 3: False}
    stats = AG.model_stats(scores, time_col="inference_ms", lexicon_sizes={"finbert": 7, "other": 1}).first()
    assert (stats.predictions, stats.failures, stats.history_length, stats.lexicon_size) == (4, 2, 2, 7) and stats.avg_inference_ms > 0
