"""Distributed history equals the single-window form and brute force;
adaptive weights normalise; rows never vanish."""

import random

import pytest
from pyspark.sql import functions as F

from feedpulse.operators import ensemble as E


def brute_perf(rows, history=100):
    """Sequential reference: per (source, model) in (created_at, id) order."""
    out, hist = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[2], r[0])):
        key = (r[1], r[3])
        h = hist.setdefault(key, [])
        if r[6]:
            h.append(r[5])
            del h[:-history]
        out[(r[0], r[3])] = 0.5 + sum(h) / len(h) if h else 1.0
    return out


def make_rows(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        src = rnd.choice(["twitter", "news", "news", "news", "forum"])  # skewed key
        for model in ("vader", "transformer"):
            rows.append((i, src, i * 37 % 5000, model, rnd.uniform(-1, 1), rnd.random(), rnd.random() > 0.15))
    return rows


def test_distributed_history_matches_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, "id long, source string, t long, model string, value double, "
                                     "confidence double, ok boolean") \
        .withColumn("created_at", F.timestamp_seconds(F.col("t") * 60)).drop("t")
    want = brute_perf(rows)
    for parts in (1, 7, 300):
        got = E.performance_factor(df, parts=parts).select("id", "model", "perf").collect()
        assert len(got) == len(rows)
        for g in got:
            assert g.perf == pytest.approx(want[(g.id, g.model)], abs=1e-12)
    win = E.performance_factor_window(df).select("id", "model", "perf").collect()
    for g in win:
        assert g.perf == pytest.approx(want[(g.id, g.model)], abs=1e-12)


def test_adaptive_weights_and_fallback(spark):
    rows = [(1, "twitter", "vader", 0.8, 0.9, True, 1.0), (1, "twitter", "transformer", -0.5, 0.6, True, 1.2),
            (2, "news", "vader", 0.3, 0.05, True, 1.0), (2, "news", "transformer", 0.0, 0.0, False, 1.0),
            (3, "web", "vader", 0.2, 0.5, True, 1.0), (3, "web", "transformer", 0.4, 0.5, True, 1.0)]
    df = spark.createDataFrame(rows, "id long, source string, model string, value double, confidence double, "
                                     "ok boolean, perf double")
    out = {r.id: r for r in E.adaptive_ensemble(E.with_fallback(df.drop("perf")).join(
        df.select("id", "model", "perf"), ["id", "model"])).collect()}
    wv, wt = 0.4 * 0.9 * 1.0, 0.5 * 0.6 * 1.2  # transformer base is always 0.5 (D2)
    assert out[1].value == pytest.approx((0.8 * wv - 0.5 * wt) / (wv + wt))
    # all confidences <= 0.1 -> equal weights over both rows (fallback 0, 0)
    assert out[2].value == pytest.approx((0.3 + 0.0) / 2)
    assert out[2].confidence == pytest.approx((0.05 + 0.0) / 2)
    wv3, wt3 = 0.2 * 0.5, 0.5 * 0.5
    assert out[3].value == pytest.approx((0.2 * wv3 + 0.4 * wt3) / (wv3 + wt3))


def test_weighted_ensemble_unnormalised(spark):
    rows = [(1, "twitter", "vader", 1.0, 1.0, True), (1, "twitter", "transformer", 1.0, 1.0, True),
            (2, "news", "vader", 1.0, 1.0, True), (2, "news", "transformer", 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "id long, source string, model string, value double, confidence double, ok boolean")
    out = {r.id: r for r in E.weighted_ensemble(E.with_fallback(df)).collect()}
    assert out[1].value == pytest.approx(0.4 + 0.3)  # D3: shrinks, no normalisation
    assert out[2].value == pytest.approx(0.2)
    norm = {r.id: r for r in E.weighted_ensemble(E.with_fallback(df), normalize=True).collect()}
    assert norm[1].value == pytest.approx(1.0)


def test_transformer_ensemble(spark):
    df = spark.createDataFrame([(1, "reddit", 1.0, 0.8, -1.0, 0.6), (2, "reuters", 1.0, 0.8, None, None)],
                               "id long, source string, finbert_value double, finbert_confidence double, "
                               "twitter_roberta_value double, twitter_roberta_confidence double")
    r = {x.id: x for x in E.transformer_ensemble(df).collect()}
    assert r[1].value == pytest.approx(0.3 - 0.7)
    assert r[2].value is None  # either model failing fails both


def test_decode_logits(spark):
    from feedpulse.operators.classify import decode_logits
    df = spark.createDataFrame([([0.0, 0.0, 2.0],), ([3.0, 1.0, 1.0],), (None,)], "l array<double>")
    r = df.select(decode_logits("l").alias("d")).collect()
    assert r[0].d.label == "positive" and r[0].d.value == 1.0
    assert r[1].d.label == "negative" and r[1].d.value == -1.0
    assert r[0].d.confidence == pytest.approx(pow(2.718281828459045, 2) / (2 + pow(2.718281828459045, 2)))
    assert r[2].d is None


def test_model_inference_keeps_rows(spark):
    from feedpulse.operators.classify import KeywordStubModel, classifier_scores
    df = spark.createDataFrame([(1, "great moon", "x"), (2, "", "x"), (3, "crash", "x")],
                               "id long, text string, source string").withColumn("created_at", F.current_timestamp())
    out = {r.id: r for r in classifier_scores(df, KeywordStubModel).collect()}
    assert len(out) == 3
    assert out[1].value == 1.0 and out[3].value == -1.0
    assert out[2].ok is False and out[2].value == 0.0  # D9: blank text keeps its row


def test_global_history_per_model(spark):
    """Process-wide history (one sequence per model across sources) - the
    exact global order - with the same distributed prefix sums."""
    rows = make_rows(2000, seed=11)
    df = spark.createDataFrame(rows, "id long, source string, t long, model string, value double, "
                                     "confidence double, ok boolean") \
        .withColumn("created_at", F.timestamp_seconds(F.col("t") * 60)).drop("t")
    hist, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[0])):
        h = hist.setdefault(r[3], [])
        if r[6]:
            h.append(r[5])
            del h[:-100]
        want[(r[0], r[3])] = 0.5 + sum(h) / len(h) if h else 1.0
    got = E.performance_factor(df, partition_by=("model",), parts=5).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.perf == pytest.approx(want[(g.id, g.model)], abs=1e-12)


def test_burst_on_one_timestamp(spark):
    """All rows of all keys share one instant: ranges cut by id; a null source is a key of its own."""
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 9 > 0, F.lit("hot")).alias("source"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("created_at"),
        F.lit("vader").alias("model"), F.lit(0.5).alias("value"), (F.col("id") * 7919 % 1000 / 1000).alias("confidence"),
        (F.floor(F.col("id") / 600) % 2 == 0).alias("ok"))  # runs of failures longer than a range
    want = {r.id: (r.succ_k, r.perf) for r in E.performance_factor(df, parts=1).collect()}
    rows = [(r.id, r.source or "", r.created_at, r.model, 0, r.confidence, r.ok) for r in df.collect()]
    brute = brute_perf(rows)
    for parts in (3, 64):
        out = E.performance_factor(df, parts=parts)
        got = {r.id: (r.succ_k, r.perf) for r in out.collect()}
        assert got == want and len(got) == 4000
        assert all(p == pytest.approx(brute[i, "vader"], abs=1e-12) for i, (_, p) in got.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Checkpoint" not in plan


def test_history_goes_on_from_a_tail(spark):
    df = spark.createDataFrame(make_rows(900), "id long, source string, t long, model string, value double, confidence double, ok boolean") \
        .withColumn("created_at", F.timestamp_seconds(F.col("t") * 60)).drop("t")
    want = {(r.id, r.model): (r.succ_k, r.perf) for r in E.performance_factor(df).collect()}
    got, tail = {}, None
    for lo, hi in ((0, 50_000), (50_000, 60_000), (60_000, 10 ** 6)):
        some = df.where(F.unix_timestamp("created_at").between(lo, hi - 1))
        out = E.performance_factor(some, carried=tail, parts=4)
        got |= {(r.id, r.model): (r.succ_k, r.perf) for r in out.collect()}
        tail = spark.createDataFrame(E.history_tail(out, tail).collect(), "source string, model string, succ_k long, confidence double")
    assert got == want
