"""V1-V8, F, W: validators return booleans, never raise."""

from pyspark.sql import functions as F

from feedpulse.functions import validate as V


def test_score_validation(spark):
    # reference test: 0.75/0.85 valid, value 2.0 invalid, confidence 1.5 invalid
    df = spark.createDataFrame([(0.75, 0.85), (2.0, 0.5), (0.5, 1.5), (None, 0.5), (float("nan"), 0.1)],
                               "v double, c double")
    got = [r.ok for r in df.select(V.score_valid("v", "c").alias("ok")).collect()]
    assert got == [True, False, False, False, False]


def test_text_source_language_symbol(spark):
    df = spark.createDataFrame([("  hi ", " Twitter ", "EN", " btc "), ("   ", "myspace", "english", "B"),
                                ("x" * 10001, "news", None, "TOOLONGSYMBOL")],
                               "t string, s string, l string, y string")
    r = df.select(V.text_valid("t").alias("t"), V.source_valid("s").alias("s"),
                  V.language_valid("l").alias("l"), V.symbol_valid("y").alias("y")).collect()
    assert [(x.t, x.s, x.l, x.y) for x in r] == [(True, True, True, True), (False, False, False, False),
                                                  (False, True, True, False)]


def test_request_and_time_range(spark):
    df = spark.createDataFrame([(" get ", "health", "2024-01-01 00:00:00", "2024-12-31 00:00:00"),
                                ("FETCH", "/a b", "2024-01-02 00:00:00", "2024-01-01 00:00:00"),
                                ("POST", "/x", "2024-01-01 00:00:00", "2025-01-02 00:00:00")],
                               "m string, e string, s string, t string")
    df = df.select("m", "e", F.col("s").cast("timestamp").alias("s"), F.col("t").cast("timestamp").alias("t"))
    r = df.select(V.request_valid("m", "e").alias("rq"), V.time_range_valid("s", "t").alias("tr")).collect()
    assert [(x.rq, x.tr) for x in r] == [(True, True), (False, False), (True, False)]


def test_weights(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5},), ({"a": 0.0, "b": 0.0},), ({"a": 2.0, "b": 2.0},)],
                               "m map<string,double>")
    r = df.select(V.weights_valid("m").alias("ok"), V.normalize_weights("m").alias("n")).collect()
    assert [x.ok for x in r] == [True, False, False]
    assert r[1].n == {"a": 0.5, "b": 0.5}
    assert r[2].n == {"a": 0.5, "b": 0.5}


def test_split_valid_keeps_every_row(spark):
    df = spark.range(100).withColumn("v", (F.col("id") % 3).cast("double") - 1.5)
    good, bad = V.split_valid(df, V.score_valid("v", F.lit(0.5)))
    assert good.count() + bad.count() == 100
