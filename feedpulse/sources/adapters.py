"""Landed-record adapters over the driver tables (FIXTURES.md section 1).

Each adapter is a plain projection of a driver table into the record schema a
platform source lands (tweets, posts, comments, feed entries, channel
messages, score rows, request logs).  They are deterministic functions of the
input rows, so their work grows with the tables.  The same projections are
written in SQL in ``feedpulse.plans.sql_adapters`` for the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

PLATFORMS = ["twitter", "reddit", "news", "telegram", "discord"]
EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z

# FIXED VALUES: injected text templates (FIXTURES.md section 3b)
TEMPLATES = [
    "Bitcoin is going to the moon! Great investment!",
    "Crypto market crash! Selling everything! $ETH",
    "Neutral market update",
    "BTC/USDT looks weak, ETHBTC too",
    "XBTCUSD breakout #SOL",
    "HODL diamond hands!",
    "paper shape definition",
    "mail me a@b.io http://x.io/p?q=1#frag <b>ADA</b>",
]
DISCORD_PREFIX = "<@!123> @everyone <#9> <:pepe:77> "
DISCORD_CHANNELS = ["crypto-general", "memes", "trading-signals", "off-topic", "defi-discussion"]


def _templated(text: Column, key: Column) -> Column:
    tpl = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (key % len(TEMPLATES)).cast("int") + 1)
    return F.concat(tpl, F.lit(" "), F.coalesce(text, F.lit("")))


def _minutes(col: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_2024) + col * 60)


def content(spark: SparkSession, sf_dir: str, templated: bool = False) -> DataFrame:
    """1.1: unified content rows (id, text, lang, source, created_at, n_chars)."""
    return content_from(table(spark, sf_dir, "documents"), templated)


def content_from(d: DataFrame, templated: bool = False) -> DataFrame:
    """1.1 over any ``documents``-shaped frame (batch or streaming)."""
    k = F.expr("cast(replace(source, 'src', '') as int) % 5")
    text = _templated(F.col("text"), F.col("doc_id")) if templated else F.col("text")
    return d.select(
        F.col("doc_id").alias("id"),
        text.alias("text"),
        "lang",
        F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]), k + 1).alias("source"),
        _minutes(F.col("doc_id")).alias("created_at"),
        "n_chars",
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.2: landed tweets (templated text so the default vocabulary occurs)."""
    return tweets_from(content(spark, sf_dir, templated=True))


def tweets_from(c: DataFrame) -> DataFrame:
    c = c.where(F.col("source") == "twitter")
    n = F.col("n_chars")
    return c.select(
        "id", "text", "created_at",
        (F.col("id") % 100).alias("author_id"),
        "lang",
        (F.col("id") % 9 == 0).alias("is_retweet"),
        F.struct((n % 97).alias("like_count"), (n % 31).alias("retweet_count"),
                 (n % 13).alias("reply_count"),
                 F.when(F.col("id") % 10 == 0, F.lit(None).cast("bigint"))
                 .otherwise(n % 7).alias("quote_count")).alias("public_metrics"),
    )


def reddit_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.3: turn 0 of each conversation is a post."""
    cv = table(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    cid = F.col("conv_id")
    body = _templated(F.col("text"), cid)
    return cv.select(
        cid.cast("string").alias("id"),
        F.split_part(body, F.lit("\n"), F.lit(1)).alias("title"),
        body.alias("selftext"),
        F.concat(F.lit("sub"), (cid % 8).cast("string")).alias("subreddit"),
        (F.lit(EPOCH_2024) + cid * 600).cast("double").alias("created_utc"),
        F.when(cid % 17 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("user"), (cid % 13).cast("string"))).alias("author"),
        F.concat(F.lit("https://reddit.example/"), cid.cast("string")).alias("url"),
        F.concat(F.lit("/r/sub"), (cid % 8).cast("string"), F.lit("/comments/"),
                 cid.cast("string")).alias("permalink"),
        F.lit(None).cast("string").alias("link_flair_text"),
        F.length(F.col("text")).cast("bigint").alias("score"),
        ((cid % 100) / 100.0).alias("upvote_ratio"),
        (cid % 50).alias("num_comments"),
        (cid % 3).alias("total_awards_received"),
        F.lit(False).alias("over_18"),
        F.lit(False).alias("spoiler"),
        (cid % 20 == 0).alias("stickied"),
        (cid % 4).alias("gilded"),
    )


def reddit_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.3: later turns are comments on the post of the same conversation."""
    cv = table(spark, sf_dir, "conversations").where(F.col("turn") > 0)
    cid, turn = F.col("conv_id"), F.col("turn")
    body = F.when((cid + turn) % 23 == 0, F.lit("[deleted]")).otherwise(
        _templated(F.col("text"), cid + turn))
    return cv.select(
        F.concat(cid.cast("string"), F.lit("_"), turn.cast("string")).alias("id"),
        body.alias("body"),
        cid.cast("string").alias("post_id"),
        F.when(turn == 1, F.concat(F.lit("t3_"), cid.cast("string")))
        .otherwise(F.concat(F.lit("t1_"), cid.cast("string"), F.lit("_"),
                            (turn - 1).cast("string"))).alias("parent_id"),
        turn.cast("int").alias("position"),
        (turn - 1).cast("int").alias("depth"),
        (F.lit(EPOCH_2024) + cid * 600 + turn * 60).cast("double").alias("created_utc"),
        F.concat(F.lit("user"), ((cid + turn) % 13).cast("string")).alias("author"),
        F.concat(F.lit("/r/c/"), cid.cast("string"), F.lit("/"), turn.cast("string")).alias("permalink"),
        (F.length(F.col("text")) % 50).cast("bigint").alias("score"),
        (F.col("role") == "user").alias("is_submitter"),
        (turn % 2).alias("gilded"),
    )


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.4: one RSS entry per page; every tenth entry is landed twice."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    p = p.unionByName(p.where(F.col("page_id") % 10 == 0))
    pid = F.col("page_id")
    return p.select(
        F.when(pid % 7 == 3, F.lit(None)).otherwise(
            F.concat(F.lit("guid-"), pid.cast("string"))).alias("guid"),
        F.concat(F.lit("Feed title "), pid.cast("string")).alias("title"),
        F.concat(F.lit("Feed summary "), pid.cast("string")).alias("summary"),
        F.col("url").alias("link"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + pid * 3600).alias("published_at"),
        F.concat(F.lit("http://feed"), (pid % 5).cast("string"),
                 F.lit(".example.org/rss")).alias("source_feed"),
        (pid / 5).cast("int").alias("position"),
    )


def telegram_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.5."""
    return telegram_from(content(spark, sf_dir, templated=True))


def telegram_from(c: DataFrame) -> DataFrame:
    c = c.where(F.col("source") == "telegram")
    i, n = F.col("id"), F.col("n_chars")
    return c.select(
        F.concat(F.lit("@ch"), (i % 6).cast("string")).alias("channel"),
        i.alias("message_id"),
        "text",
        F.col("created_at").alias("date"),
        F.struct((i % 40).alias("id"), F.concat(F.lit("u"), (i % 40).cast("string")).alias("username"),
                 F.concat(F.lit("Name"), (i % 40).cast("string")).alias("first_name"),
                 (i % 25 == 0).alias("is_bot")).alias("sender"),
        F.when(i % 9 == 0, F.lit(None).cast("bigint")).otherwise(n * 3).alias("views"),
        (n % 11).alias("forwards"),
        (n % 5).alias("reply_count"),
        (i % 4 == 0).alias("has_media"),
        (i % 6 == 1).alias("is_reply"),
        (i % 8 == 2).alias("is_forwarded"),
    )


def discord_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.6."""
    return discord_from(content(spark, sf_dir, templated=True))


def discord_from(c: DataFrame) -> DataFrame:
    c = c.where(F.col("source") == "discord")
    i, n = F.col("id"), F.col("n_chars")
    names = F.array(*[F.lit(x) for x in DISCORD_CHANNELS])
    return c.select(
        (i % 3 + 1).alias("guild_id"),
        F.concat(F.lit("guild"), (i % 3 + 1).cast("string")).alias("guild_name"),
        (i % 5 + 100).alias("channel_id"),
        F.element_at(names, (i % 5 + 1).cast("int")).alias("channel_name"),
        i.alias("message_id"),
        F.concat(F.lit(DISCORD_PREFIX), F.col("text")).alias("content"),
        "created_at",
        F.struct((i % 30).cast("string").alias("id"),
                 F.concat(F.lit("d"), (i % 30).cast("string")).alias("username"),
                 F.lit("0001").alias("discriminator"),
                 F.concat(F.lit("D"), (i % 30).cast("string")).alias("display_name"),
                 (i % 20 == 0).alias("is_bot"),
                 F.lit(None).cast("string").alias("avatar_url")).alias("author"),
        F.array(F.struct(F.lit("+1").alias("emoji"), (n % 5).alias("count")),
                F.struct(F.lit("rocket").alias("emoji"), (n % 3).alias("count"))).alias("reactions"),
        F.when(i % 4 == 0, F.array(F.lit("u1"), F.lit("u2")))
        .otherwise(F.array().cast("array<string>")).alias("mentions"),
        F.lit(0).alias("attachments"),
        F.lit(0).alias("embeds"),
        F.lit(None).cast("bigint").alias("reference_id"),
        F.lit(False).alias("pinned"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.8: request / event log from ``events``."""
    ev = table(spark, sf_dir, "events")
    fail = F.col("event_type") == "error"
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("key"),
        F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.when(fail, 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
        fail.alias("is_failure"),
        "event_type",
    )


def stub_classifier_scores(c: DataFrame) -> DataFrame:
    """1.7: deterministic stand-in for a transformer model (no model offline)."""
    i = F.col("id")
    return c.select(
        "id", "source", "created_at",
        F.lit("transformer").alias("model"),
        (((i * 7) % 201 - 100) / 100.0).alias("value"),
        (((i * 13) % 101) / 100.0).alias("confidence"),
        (i % 11 != 0).alias("ok"),
    )


def stub_logits(c: DataFrame) -> DataFrame:
    """1.7: logit vectors for the classifier decoder (M3)."""
    i = F.col("id")
    return c.select("id", "source", F.array((i * 3) % 17 / 4.0, (i * 5) % 19 / 4.0,
                                            (i * 7) % 23 / 4.0).alias("logits"))
