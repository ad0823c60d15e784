"""Nothing is dropped silently: long texts, wide models, failing models, many channels, slow streams."""

import pytest
from pyspark.sql import functions as F

from feedpulse.functions import mentions as M
from feedpulse.operators import classify as C
from feedpulse.operators import lexicon as L
from feedpulse.operators import normalize as N
from feedpulse.operators import search as SE
from feedpulse.streaming import streams as ST

MESSAGE = ("channel string, message_id long, text string, date timestamp, sender struct<id long, username string, "
           "first_name string, is_bot boolean>, views long, forwards long, reply_count long, has_media boolean, "
           "is_reply boolean, is_forwarded boolean")


def messages(spark, texts):
    rows = [(f"@c{i}", i, t, None, (1, "u", "f", False), 1, 1, 1, False, False, False) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, MESSAGE).withColumn("date", F.timestamp_seconds(F.col("message_id") * 60))


def test_long_texts_are_normalised_and_scored(spark):
    long_text = "great " * 4000
    assert N.normalize_telegram(messages(spark, [long_text])).count() == 1
    got = L.lexicon_score(spark.createDataFrame([(1, long_text)], "id long, text string"), L.default_lexicon(spark)).first()
    assert got.ok and got.hits == 4000


def test_five_classes_and_wrong_widths(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    five = C.score_with_model(df, lambda: lambda texts: [[0, 0, 0, 0, 9]] * len(texts), n_labels=5).collect()
    assert [r.logits for r in five] == [[0, 0, 0, 0, 9]] * 2
    with pytest.raises(Exception, match="5 logits for 3 labels"):
        C.score_with_model(df, lambda: lambda texts: [[0, 0, 0, 0, 9]] * len(texts)).collect()
    with pytest.raises(Exception, match="1 results for 2 texts"):
        C.score_with_model(df.coalesce(1), lambda: lambda texts: [[0, 0, 9]]).collect()


def test_one_failing_text_keeps_the_others(spark):
    def factory():
        def predict(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return [[0.0, 0.0, 9.0]] * len(texts)
        return predict
    df = spark.createDataFrame([(i, "bad" if i == 3 else "fine") for i in range(8)], "id long, text string") \
        .withColumns({"source": F.lit("news"), "created_at": F.lit(None).cast("timestamp")})
    raw = {r.id: r for r in C.score_with_model(df, factory).collect()}
    assert raw[3].logits is None and raw[3].error == "RuntimeError: no"
    got = {r.id: r for r in C.classifier_scores(df, factory).collect()}
    assert {i for i, r in got.items() if not r.ok} == {3}
    assert (got[3].value, got[3].confidence) == (0.0, 0.0)


def test_more_channels_than_limit(spark):
    m = messages(spark, ["look, the moon"] * 12)
    got = SE.search_telegram(m, "the", [f"@c{i}" for i in range(12)], limit=5).collect()
    assert [r.message_id for r in got] == [11, 10, 9, 8, 7]


def test_pair_mentions_in_one_long_run_are_linear(spark):
    import time
    text = "A" * 200_000 + "BTCUSDT X" + "B" * 200_000 + "ETH/USDT, ADAUSDTX"
    df = spark.createDataFrame([(text,)], "t string").cache()
    df.count()
    M_got = df.select(M.mentions("t", "telegram").alias("m"))
    M_got.collect()
    began = time.time()
    assert M_got.first().m == ["BTC", "ETH"]
    assert time.time() - began < 5


def test_stream_waits_for_all_files(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(200).repartition(10).write.parquet(src)
    df = ST.read_landed(spark, src, max_files_per_trigger=1)
    out = ST.run_to_parquet(df, "all-files")
    assert spark.read.parquet(out).count() == 200


def test_persisted_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "content")
    c = spark.createDataFrame([(1, "news", 0), (2, "news", 90000)], "id long, source string, t long") \
        .withColumn("created_at", F.timestamp_seconds("t")).drop("t")
    for batch in (0, 0, 1):
        ST.persist_content(c, path, batch)
    assert spark.read.parquet(path).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 2), (1, 2)]


def test_time_filters_need_a_time(spark):
    posts = spark.createDataFrame([], "id string, title string, selftext string, subreddit string, created_utc double, "
                                      "score long, num_comments long")
    with pytest.raises(ValueError, match="as_of"):
        SE.search_reddit(posts, "x")


def test_search_runs_at_the_newest_tweet(spark, tmp_path):
    """S1 on a table whose rows all lie after March 2024 finds what it finds in one before."""
    from pyspark.sql import functions as F

    from feedpulse.plans.catalog import REGISTRY
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    shift = 45 * 100 * 1000  # minutes: a multiple of what the landed fields are derived by
    docs.withColumn("doc_id", F.col("doc_id") + shift).write.parquet(f"{tmp_path}/documents.parquet")
    late = REGISTRY["S1_search_tweets"].build(spark, str(tmp_path))
    early = REGISTRY["S1_search_tweets"].build(spark, SF_SMALL)
    got = sorted((int(r.id) - shift, r.symbol) for r in late.collect())
    assert got and got == sorted((int(r.id), r.symbol) for r in early.collect())
