"""Per-platform record normalisers (N2-N6) into the content core.

Content core: ``id, text (clean), original_text, symbols_mentioned, source,
created_at, metrics STRUCT, metadata STRUCT`` plus nullable platform columns;
the platforms combine with ``unionByName(allowMissingColumns=True)`` (U1).

Each normaliser applies the platform's drop rules as filters (empty text,
minimum length, tombstones, empty after cleaning) and
is a single narrow projection: no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import mentions as M
from ..functions import text as T
from ..functions import validate as V


def _z(c) -> Column:
    """Missing metric -> 0."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def _cleaned(df: DataFrame, raw: Column) -> DataFrame:
    return df.withColumn("__clean", T.sanitize(raw))


def _valid_clean() -> Column:
    # long texts stay whole: V1's upper length is a flag for the caller, not a filter
    return F.length("__clean") >= 1


def normalize_tweets(df: DataFrame, symbol_col: str | None = None,
                     symbols=vocab.CRYPTO_SYMBOLS) -> DataFrame:
    """Landed tweets -> content rows (cleaned >= 10 chars)."""
    d = df.where(F.col("text").isNotNull() & (F.col("text") != ""))
    d = _cleaned(d, F.col("text")).where((F.length("__clean") >= 10) & _valid_clean())
    pm = "public_metrics"
    likes, rts = _z(f"{pm}.like_count"), _z(f"{pm}.retweet_count")
    reps, quotes = _z(f"{pm}.reply_count"), _z(f"{pm}.quote_count")
    w = vocab.TWEET_ENGAGEMENT
    eng = likes * w["likes"] + rts * w["retweets"] + reps * w["replies"] + quotes * w["quotes"]
    sym = F.col(symbol_col) if symbol_col else F.lit(None).cast("string")
    return d.select(
        F.col("id").cast("string").alias("id"),
        F.col("__clean").alias("text"),
        F.col("text").alias("original_text"),
        sym.alias("symbol"),
        M.mentions(F.col("text"), "twitter", symbols).alias("symbols_mentioned"),
        F.lit("twitter").alias("source"),
        F.col("created_at"),
        F.col("author_id").cast("string").alias("author_id"),
        F.struct(likes.alias("likes"), rts.alias("retweets"), reps.alias("replies"),
                 quotes.alias("quotes"), eng.cast("double").alias("engagement_score")).alias("metrics"),
        F.struct(F.lit("en").alias("language"), F.lit("twitter").alias("platform"),
                 F.lit("text").alias("content_type")).alias("metadata"),
    )


def normalize_posts(df: DataFrame, symbols=vocab.CRYPTO_SYMBOLS) -> DataFrame:
    """Posts; text = title + '. ' + selftext (T7), raw length >= 10."""
    d = df.withColumn("__full", T.post_text("title", "selftext"))
    d = d.where(F.length("__full") >= 10)
    d = _cleaned(d, F.col("__full")).where(_valid_clean())
    return d.select(
        F.col("id"),
        F.col("__clean").alias("text"),
        F.col("__full").alias("original_text"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        M.mentions(F.col("__full"), "reddit", symbols).alias("symbols_mentioned"),
        F.lit("reddit").alias("source"),
        F.col("subreddit"),
        T.epoch_to_timestamp("created_utc").alias("created_at"),
        F.coalesce(F.col("author"), F.lit("deleted")).alias("author"),
        F.col("url"),
        F.concat(F.lit("https://reddit.com"), F.col("permalink")).alias("permalink"),
        F.struct(F.col("score"), F.col("upvote_ratio"), F.col("num_comments"),
                 F.col("total_awards_received").alias("awards")).alias("metrics"),
        F.struct(F.lit("en").alias("language"), F.lit("reddit").alias("platform"),
                 F.lit("post").alias("content_type"),
                 F.coalesce(F.col("link_flair_text"), F.lit("")).alias("flair"),
                 F.col("over_18").alias("is_nsfw"), F.col("spoiler").alias("is_spoiler"),
                 F.col("stickied").alias("is_stickied"),
                 (F.col("gilded") > 0).alias("gilded")).alias("metadata"),
    )


def normalize_comments(df: DataFrame, symbols=vocab.CRYPTO_SYMBOLS) -> DataFrame:
    """Comments; raw length >= 5, tombstones dropped (F2)."""
    body = F.coalesce(F.col("body"), F.lit(""))
    d = df.where((body != "") & V.min_length(body, 5) & V.not_tombstone(body))
    d = _cleaned(d, body).where(_valid_clean())
    return d.select(
        F.col("id"),
        F.col("__clean").alias("text"),
        F.col("body").alias("original_text"),
        M.mentions(F.col("body"), "reddit", symbols).alias("symbols_mentioned"),
        F.lit("reddit").alias("source"),
        F.col("post_id").alias("parent_post_id"),
        T.epoch_to_timestamp("created_utc").alias("created_at"),
        F.coalesce(F.col("author"), F.lit("deleted")).alias("author"),
        F.concat(F.lit("https://reddit.com"), F.col("permalink")).alias("permalink"),
        F.col("position"),
        F.struct(F.col("score"), F.col("is_submitter"), F.col("gilded")).alias("metrics"),
        F.struct(F.lit("en").alias("language"), F.lit("reddit").alias("platform"),
                 F.lit("comment").alias("content_type"), F.col("depth"),
                 F.col("parent_id").startswith("t3_").alias("is_root")).alias("metadata"),
    )


def normalize_telegram(df: DataFrame, symbols=vocab.CRYPTO_SYMBOLS) -> DataFrame:
    """id = channel_messageid; engagement 0.1*views + 2*forwards + 1.5*replies."""
    txt = F.col("text")
    d = df.where(txt.isNotNull() & (txt != "") & (F.length(txt) >= 5))
    d = _cleaned(d, txt).where(_valid_clean())
    w = vocab.TELEGRAM_ENGAGEMENT
    views, fwd, rep = _z("views"), _z("forwards"), _z("reply_count")
    return d.select(
        F.concat(F.col("channel"), F.lit("_"), F.col("message_id").cast("string")).alias("id"),
        F.col("__clean").alias("text"),
        txt.alias("original_text"),
        M.mentions(txt, "telegram", symbols).alias("symbols_mentioned"),
        F.lit("telegram").alias("source"),
        F.col("channel"),
        F.col("message_id"),
        F.col("date").alias("created_at"),
        F.struct(F.col("sender.id").cast("string").alias("id"), F.col("sender.username").alias("username"),
                 F.coalesce(F.col("sender.first_name"), F.lit("")).alias("first_name"),
                 F.coalesce(F.col("sender.is_bot"), F.lit(False)).alias("is_bot")).alias("author"),
        F.struct(views.alias("views"), fwd.alias("forwards"), rep.alias("replies"),
                 (views * w["views"] + fwd * w["forwards"] + rep * w["replies"]).cast("double")
                 .alias("engagement_score")).alias("metrics"),
        F.struct(F.lit("en").alias("language"), F.lit("telegram").alias("platform"),
                 F.lit("message").alias("content_type"),
                 F.coalesce(F.col("has_media"), F.lit(False)).alias("has_media"),
                 F.coalesce(F.col("is_reply"), F.lit(False)).alias("is_reply"),
                 F.coalesce(F.col("is_forwarded"), F.lit(False)).alias("is_forwarded")).alias("metadata"),
    )


def normalize_discord(df: DataFrame, symbols=vocab.CRYPTO_SYMBOLS) -> DataFrame:
    """Markup stripped (T6) before T1; id = guild_channel_message."""
    raw = F.col("content")
    d = df.where(raw.isNotNull() & (raw != "") & (F.length(raw) >= 5))
    d = d.withColumn("__stripped", T.strip_discord_markup(raw))
    d = _cleaned(d, F.col("__stripped")).where(_valid_clean())
    w = vocab.DISCORD_ENGAGEMENT
    reactions = F.aggregate(F.coalesce(F.col("reactions"), F.array()), F.lit(0).cast("long"),
                            lambda a, r: a + F.coalesce(r["count"], F.lit(0)).cast("long"))
    n_mentions = F.size(F.coalesce(F.col("mentions"), F.array().cast("array<string>"))).cast("long")
    return d.select(
        F.concat_ws("_", F.col("guild_id").cast("string"), F.col("channel_id").cast("string"),
                    F.col("message_id").cast("string")).alias("id"),
        F.col("__clean").alias("text"),
        raw.alias("original_text"),
        M.mentions(F.col("__stripped"), "discord", symbols).alias("symbols_mentioned"),
        F.lit("discord").alias("source"),
        F.col("guild_name").alias("server_name"),
        F.col("guild_id").cast("string").alias("server_id"),
        F.col("channel_name"),
        F.col("channel_id").cast("string").alias("channel_id"),
        F.col("message_id").cast("string").alias("message_id"),
        F.col("created_at"),
        F.col("author"),
        F.struct(reactions.alias("reactions_count"), n_mentions.alias("mentions_count"),
                 T.has_link(raw).alias("has_links"),
                 F.length("__clean").alias("message_length"),
                 (reactions * w["reactions"] + n_mentions * w["mentions"]).cast("double")
                 .alias("engagement_score")).alias("metrics"),
        F.struct(F.lit("en").alias("language"), F.lit("discord").alias("platform"),
                 F.lit("message").alias("content_type"),
                 (F.coalesce(F.col("attachments"), F.lit(0)) > 0).alias("has_attachments"),
                 (F.coalesce(F.col("embeds"), F.lit(0)) > 0).alias("has_embeds"),
                 F.col("reference_id").isNotNull().alias("is_reply"),
                 F.coalesce(F.col("pinned"), F.lit(False)).alias("is_pinned")).alias("metadata"),
    )


def _author_as_name(df: DataFrame) -> DataFrame:
    """Platforms land ``author`` as a name or as a struct: keep the struct as
    ``author_info`` and expose the user name as ``author``."""
    from pyspark.sql.types import StructType
    if "author" in df.columns and isinstance(df.schema["author"].dataType, StructType):
        return (df.withColumnRenamed("author", "author_info")
                  .withColumn("author", F.col("author_info.username")))
    return df


def union_content(*frames: DataFrame) -> DataFrame:
    """Concatenate platform frames (UNION ALL by name, missing -> null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [_author_as_name(f) for f in frames])
