"""Registered queries: normalisers (N2-N6), source scans (S1-S4, S7-S12),
unions and dedup (U1-U3), implicit joins (J1, J5, J7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocab
from ..operators import fetch as FE
from ..operators import normalize as N
from ..operators.seen import SeenIds
from ..sources import adapters as A
from ..sources.tables import table
from . import sql_adapters as S
from . import sql_text as ST
from .registry import arr_str, r6, register, ts_str

q = S.q
AS_OF = "2024-03-01 00:00:00"     # fixed evaluation instant (never the wall clock)
WIDE_HOURS = 24 * 60              # window covering the fixture time span


def _ms(col, dialect):
    return f"array_to_string({ST.mentions_list(col, dialect)}, ',')"


# --- SQL normalisers (oracle side) ------------------------------------------------

def tweets_norm_sql():
    return f"""SELECT CAST(id AS VARCHAR) AS id, {S.sanitize('text')} AS clean, text, created_at,
      coalesce(like_count, 0) * 1.0 + coalesce(retweet_count, 0) * 2.0 + coalesce(reply_count, 0) * 1.5
        + coalesce(quote_count, 0) * 2.0 AS engagement, {_ms('text', 'twitter')} AS symbols
    FROM ({S.tweets()}) t WHERE text IS NOT NULL AND text <> ''"""


def _keep_clean(min_len=1):
    return f"length(clean) >= {max(min_len, 1)}"


def posts_norm_sql():
    full = S.strip_ws("coalesce(title, '') || '. ' || coalesce(selftext, '')")
    return f"""SELECT * FROM (SELECT id, full_text, {S.sanitize('full_text')} AS clean, subreddit,
      coalesce(author, 'deleted') AS author, 'https://reddit.com' || permalink AS permalink,
      gilded > 0 AS gilded, score, created_utc, {_ms('full_text', 'reddit')} AS symbols
      FROM (SELECT *, {full} AS full_text FROM ({S.reddit_posts()}) p0) p1
      WHERE length(full_text) >= 10) p WHERE {_keep_clean()}"""


def comments_norm_sql():
    return f"""SELECT * FROM (SELECT id, post_id, position, {S.sanitize('body')} AS clean,
      starts_with(parent_id, 't3_') AS is_root, {_ms('body', 'reddit')} AS symbols
      FROM ({S.reddit_comments()}) c WHERE coalesce(body, '') <> '' AND length(body) >= 5
        AND body NOT IN ('[deleted]', '[removed]')) x WHERE {_keep_clean()}"""


def telegram_norm_sql():
    return f"""SELECT * FROM (SELECT channel || '_' || CAST(message_id AS VARCHAR) AS id, channel, message_id,
      date AS created_at, {S.sanitize('text')} AS clean,
      coalesce(views, 0) * 0.1 + coalesce(forwards, 0) * 2.0 + coalesce(reply_count, 0) * 1.5 AS engagement,
      {_ms('text', 'telegram')} AS symbols
      FROM ({S.telegram_messages()}) m WHERE text IS NOT NULL AND text <> '' AND length(text) >= 5) x
    WHERE {_keep_clean()}"""


def _discord_strip_sql(x):
    from ..functions import patterns as P
    for pat in (P.DISCORD_USER, P.DISCORD_EVERYONE, P.DISCORD_CHANNEL, P.DISCORD_EMOJI):
        x = f"regexp_replace({x}, {q(pat)}, '', 'g')"
    return x


def discord_norm_sql():
    return f"""SELECT * FROM (SELECT CAST(guild_id AS VARCHAR) || '_' || CAST(channel_id AS VARCHAR) || '_'
        || CAST(message_id AS VARCHAR) AS id, channel_id, channel_name, created_at, message_id,
      {S.sanitize('stripped')} AS clean, CAST(reactions_count AS BIGINT) AS reactions_count,
      CAST(mentions_count AS BIGINT) AS mentions_count,
      coalesce(regexp_matches(content, 'https?://'), false) AS has_links,
      reactions_count * 2.0 + mentions_count * 0.5 AS engagement, {_ms('stripped', 'discord')} AS symbols
      FROM (SELECT *, {_discord_strip_sql('content')} AS stripped FROM ({S.discord_messages()}) d0) d
      WHERE content IS NOT NULL AND content <> '' AND length(content) >= 5) x WHERE {_keep_clean()}"""


# --- N: normalisers ---------------------------------------------------------------

@register("N2_normalize_tweets", sql=f"""
SELECT id, clean AS text, symbols, {S.r6('engagement')} AS engagement FROM ({tweets_norm_sql()}) x
WHERE {_keep_clean(10)}""")
def n2(spark, sf):
    n = N.normalize_tweets(A.tweets(spark, sf))
    return n.select("id", "text", arr_str("symbols_mentioned").alias("symbols"),
                    r6("metrics.engagement_score").alias("engagement"))


@register("N3_normalize_posts", sql=f"""
SELECT id, clean AS text, author, permalink, gilded, symbols,
  strftime(TIMESTAMP '1970-01-01 00:00:00' + to_microseconds(CAST(created_utc * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS created_at
FROM ({posts_norm_sql()}) x""")
def n3(spark, sf):
    n = N.normalize_posts(A.reddit_posts(spark, sf))
    return n.select("id", "text", "author", "permalink", F.col("metadata.gilded").alias("gilded"),
                    arr_str("symbols_mentioned").alias("symbols"), ts_str("created_at").alias("created_at"))


@register("N4_normalize_comments", sql=f"""
SELECT id, clean AS text, post_id AS parent_post_id, is_root, symbols FROM ({comments_norm_sql()}) x""")
def n4(spark, sf):
    n = N.normalize_comments(A.reddit_comments(spark, sf))
    return n.select("id", "text", "parent_post_id", F.col("metadata.is_root").alias("is_root"),
                    arr_str("symbols_mentioned").alias("symbols"))


@register("N5_normalize_telegram", sql=f"""
SELECT id, clean AS text, {S.r6('engagement')} AS engagement, symbols FROM ({telegram_norm_sql()}) x""")
def n5(spark, sf):
    n = N.normalize_telegram(A.telegram_messages(spark, sf))
    return n.select("id", "text", r6("metrics.engagement_score").alias("engagement"),
                    arr_str("symbols_mentioned").alias("symbols"))


@register("N6_normalize_discord", sql=f"""
SELECT id, clean AS text, reactions_count, mentions_count, has_links,
  CAST(length(clean) AS INTEGER) AS message_length, {S.r6('engagement')} AS engagement, symbols
FROM ({discord_norm_sql()}) x""")
def n6(spark, sf):
    n = N.normalize_discord(A.discord_messages(spark, sf))
    return n.select("id", "text", F.col("metrics.reactions_count").alias("reactions_count"),
                    F.col("metrics.mentions_count").alias("mentions_count"),
                    F.col("metrics.has_links").alias("has_links"),
                    F.col("metrics.message_length").alias("message_length"),
                    r6("metrics.engagement_score").alias("engagement"),
                    arr_str("symbols_mentioned").alias("symbols"))


# --- S: source scans ------------------------------------------------------------------

def _rn(part, order):
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {order})"


@register("S1_search_tweets", sql=f"""
WITH t AS (SELECT *, unnest({ST.search_symbols('text', vocab.CRYPTO_SYMBOLS[:5])}) AS symbol FROM ({S.tweets()}) t0
           WHERE lang = 'en' AND NOT coalesce(is_retweet, false)
             AND created_at >= (SELECT max(created_at) FROM ({S.tweets()}) m) - INTERVAL {WIDE_HOURS} HOUR),
c AS (SELECT * FROM (SELECT *, {_rn('symbol', 'created_at DESC, id DESC')} AS rn FROM t) x WHERE rn <= 100),
n AS (SELECT CAST(id AS VARCHAR) AS id, symbol, {S.sanitize('text')} AS clean FROM c WHERE text <> '')
SELECT id, symbol, clean AS text FROM n WHERE {_keep_clean(10)} AND {ST.relevant('clean', 'twitter')}""")
def s1(spark, sf):
    t = A.tweets(spark, sf)
    latest = t.agg(F.max("created_at")).first()[0]  # the search runs at the newest landed tweet
    r = FE.search_tweets(t, latest, hours_back=WIDE_HOURS)
    return r.select("id", "symbol", "text")


@register("S2_subreddit_posts", sql=f"""
WITH c AS (SELECT * FROM (SELECT *, {_rn('subreddit', 'score DESC, created_utc DESC, id DESC')} AS rn
           FROM ({S.reddit_posts()}) p) x WHERE rn <= 5),
n AS (SELECT * FROM (SELECT id, subreddit, full_text, {S.sanitize('full_text')} AS clean
      FROM (SELECT *, {S.strip_ws("coalesce(title, '') || '. ' || coalesce(selftext, '')")} AS full_text FROM c) c1
      WHERE length(full_text) >= 10) c2 WHERE {_keep_clean()})
SELECT id, subreddit, clean AS text FROM n WHERE {ST.relevant('clean', 'reddit')}""")
def s2(spark, sf):
    r = FE.subreddit_posts(A.reddit_posts(spark, sf), limit=5, sort_type="hot")
    return r.select("id", "subreddit", "text")


@register("S2_subreddit_top_week", sql=f"""
WITH c AS (SELECT * FROM (SELECT *, {_rn('subreddit', 'score DESC, id DESC')} AS rn
           FROM ({S.reddit_posts()}) p WHERE created_utc >= epoch(TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 168 HOUR)) x
           WHERE rn <= 3),
n AS (SELECT * FROM (SELECT id, subreddit, {S.sanitize('full_text')} AS clean
      FROM (SELECT *, {S.strip_ws("coalesce(title, '') || '. ' || coalesce(selftext, '')")} AS full_text FROM c) c1
      WHERE length(full_text) >= 10) c2 WHERE {_keep_clean()})
SELECT id, subreddit FROM n""")
def s2b(spark, sf):
    r = FE.subreddit_posts(A.reddit_posts(spark, sf), as_of="2024-01-08 00:00:00", limit=3,
                           sort_type="top", time_filter="week", relevant_only=False)
    return r.select("id", "subreddit")


def _comments_capped_sql(limit, where="true"):
    return f"""SELECT * FROM (SELECT *, {_rn('post_id', 'position, id')} AS rn FROM ({S.reddit_comments()}) c0
      WHERE {where}) x WHERE rn <= {limit}"""


@register("S3_post_comments", sql=f"""
WITH n AS (SELECT * FROM (SELECT id, post_id, {S.sanitize('body')} AS clean FROM ({_comments_capped_sql(3)}) c
      WHERE coalesce(body, '') <> '' AND length(body) >= 5 AND body NOT IN ('[deleted]', '[removed]')) x
      WHERE {_keep_clean()})
SELECT id, post_id AS parent_post_id FROM n WHERE {ST.relevant('clean', 'reddit')}""")
def s3(spark, sf):
    r = FE.post_comments(A.reddit_comments(spark, sf), limit=3)
    return r.select("id", "parent_post_id")


def _s4_sql():
    posts = f"""SELECT id, subreddit, score, clean FROM (SELECT *, {S.sanitize('full_text')} AS clean FROM (
        SELECT *, {S.strip_ws("coalesce(title, '') || '. ' || coalesce(selftext, '')")} AS full_text FROM (
          SELECT *, {_rn('subreddit', 'score DESC, created_utc DESC, id DESC')} AS rn FROM ({S.reddit_posts()}) p) x
        WHERE rn <= 50) y WHERE length(full_text) >= 10) z WHERE {_keep_clean()} AND {ST.relevant('clean', 'reddit')}"""
    return f"""
WITH p AS ({posts}),
best AS (SELECT id FROM (SELECT id, {_rn('subreddit', 'score DESC, id')} AS rn FROM p) b WHERE rn <= 10),
cm AS (SELECT * FROM (SELECT *, {_rn('post_id', 'position, id')} AS rn FROM ({S.reddit_comments()}) c
       WHERE post_id IN (SELECT id FROM best)) x WHERE rn <= 20),
cn AS (SELECT * FROM (SELECT id, {S.sanitize('body')} AS clean FROM cm
       WHERE coalesce(body, '') <> '' AND length(body) >= 5 AND body NOT IN ('[deleted]', '[removed]')) x
       WHERE {_keep_clean()} AND {ST.relevant('clean', 'reddit')})
SELECT id, 'post' AS kind FROM p UNION ALL SELECT id, 'comment' FROM cn"""


@register("S4_crypto_threads", sql=_s4_sql())
def s4(spark, sf):
    r = FE.crypto_threads(A.reddit_posts(spark, sf), A.reddit_comments(spark, sf))
    return r.select("id", F.when(F.col("parent_post_id").isNull(), "post").otherwise("comment").alias("kind"))


def _telegram_scan_sql(channels, limit, hours):
    chan = "true" if channels is None else f"channel IN ({', '.join(q(c) for c in channels)})"
    return f"""
WITH m AS (SELECT * FROM ({S.telegram_messages()}) m0 WHERE {chan}
           AND date >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR),
c AS (SELECT * FROM (SELECT *, {_rn('channel', 'date DESC, message_id DESC')} AS rn FROM m) x WHERE rn <= {limit}),
n AS (SELECT * FROM (SELECT channel || '_' || CAST(message_id AS VARCHAR) AS id, channel, {S.sanitize('text')} AS clean
      FROM c WHERE text IS NOT NULL AND text <> '' AND length(text) >= 5) x WHERE {_keep_clean()})
SELECT DISTINCT id, channel FROM n WHERE {ST.relevant('clean', 'telegram')}"""


@register("S7_channel_messages", sql=_telegram_scan_sql(["@ch1"], 20, WIDE_HOURS))
def s7(spark, sf):
    r = FE.channel_messages(A.telegram_messages(spark, sf), AS_OF, channels=["@ch1"], limit=20,
                            hours_back=WIDE_HOURS)
    return r.select("id", "channel")


@register("S8_all_channels", sql=_telegram_scan_sql(None, 10, WIDE_HOURS))
def s8(spark, sf):
    r = FE.channel_messages(A.telegram_messages(spark, sf), AS_OF, limit=10, hours_back=WIDE_HOURS)
    return r.select("id", "channel")


@register("S9_channel_history", sql=f"""
WITH m AS (SELECT * FROM ({S.discord_messages()}) m0 WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL {WIDE_HOURS} HOUR),
c AS (SELECT * FROM (SELECT *, {_rn('channel_id', 'created_at DESC, message_id DESC')} AS rn FROM m) x WHERE rn <= 15),
n AS (SELECT * FROM (SELECT CAST(guild_id AS VARCHAR) || '_' || CAST(channel_id AS VARCHAR) || '_' || CAST(message_id AS VARCHAR) AS id,
        channel_id, {S.sanitize(_discord_strip_sql('content'))} AS clean
      FROM c WHERE content IS NOT NULL AND content <> '' AND length(content) >= 5) x WHERE {_keep_clean()})
SELECT DISTINCT id, channel_id FROM n WHERE {ST.relevant('clean', 'discord')}""")
def s9(spark, sf):
    r = FE.channel_messages(A.discord_messages(spark, sf), AS_OF, limit=15, hours_back=WIDE_HOURS,
                            platform="discord", strict=True)
    return r.select("id", F.col("channel_id").cast("bigint").alias("channel_id"))


def _monitored_sql():
    cond = " OR ".join(f"contains(lower(channel_name), {q(t)})" for t in vocab.DISCORD_CHANNEL_TERMS)
    return cond


@register("S10_monitored_channels", sql=f"""
SELECT channel_id, count(*) AS n_messages FROM ({S.discord_messages()}) m
WHERE channel_id IN (SELECT DISTINCT channel_id FROM ({S.discord_messages()}) d WHERE {_monitored_sql()})
GROUP BY channel_id""")
def s10(spark, sf):
    d = A.discord_messages(spark, sf)
    dims = d.select("channel_id", "channel_name").distinct()
    m = FE.monitored_messages(d, dims)
    return m.groupBy("channel_id").agg(F.count("*").alias("n_messages"))


@register("S11_channel_info", sql=f"""
WITH m AS ({S.telegram_messages()}),
info AS (SELECT channel, upper(channel) AS channel_title, count(DISTINCT sender_id) AS participants_count
         FROM m WHERE channel <> '@ch0' GROUP BY channel)
SELECT m.message_id, coalesce(info.channel_title, '') AS channel_title,
       coalesce(info.participants_count, 0) AS participants_count, 'channel' AS channel_type
FROM m LEFT JOIN info ON m.channel = info.channel""")
def s11(spark, sf):
    m = A.telegram_messages(spark, sf)
    info = (m.where(F.col("channel") != "@ch0").groupBy("channel")
             .agg(F.upper("channel").alias("channel_title"),
                  F.count_distinct("sender.id").alias("participants_count"))
             .withColumn("channel_type", F.lit(None).cast("string")))
    j = FE.with_channel_info(m, info)
    return j.select("message_id", "channel_title", "participants_count", "channel_type")


@register("S12_fetch_api", sql=f"""
WITH n AS ({telegram_norm_sql()})
SELECT id FROM (SELECT id, created_at FROM n WHERE list_contains(string_split(symbols, ','), 'BTC')
  AND created_at >= (SELECT max(date) FROM ({S.telegram_messages()}) t) - INTERVAL 168 HOUR
  ORDER BY created_at DESC, id DESC LIMIT 100) x""")
def s12(spark, sf):
    m = A.telegram_messages(spark, sf)
    latest = m.agg(F.max("date")).first()[0]  # the API's "now" is the newest landed message
    return FE.fetch(N.normalize_telegram(m), "telegram", latest, symbol="BTC", limit=100, hours_back=168).select("id")


@register("S12_fetch_api_recent", sql=f"""
WITH n AS ({telegram_norm_sql()})
SELECT id FROM (SELECT id, created_at FROM n WHERE list_contains(string_split(symbols, ','), 'BTC')
  AND created_at >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '2024-01-02 00:00:00'
  ORDER BY created_at DESC, id DESC LIMIT 100) x""")
def s12b(spark, sf):
    n = N.normalize_telegram(A.telegram_messages(spark, sf))
    return FE.fetch(n, "telegram", "2024-01-02 00:00:00", symbol="BTC", limit=100, hours_back=24).select("id")


# --- U / J --------------------------------------------------------------------------

@register("U1_union_content", sql=f"""
SELECT source, count(*) AS n FROM (
  SELECT 'twitter' AS source FROM ({tweets_norm_sql()}) a WHERE {_keep_clean(10)}
  UNION ALL SELECT 'reddit' FROM ({posts_norm_sql()}) b
  UNION ALL SELECT 'reddit' FROM ({comments_norm_sql()}) c
  UNION ALL SELECT 'telegram' FROM ({telegram_norm_sql()}) d
  UNION ALL SELECT 'discord' FROM ({discord_norm_sql()}) e) u GROUP BY source""")
def u1(spark, sf):
    u = N.union_content(N.normalize_tweets(A.tweets(spark, sf)),
                        N.normalize_posts(A.reddit_posts(spark, sf)),
                        N.normalize_comments(A.reddit_comments(spark, sf)),
                        N.normalize_telegram(A.telegram_messages(spark, sf)),
                        N.normalize_discord(A.discord_messages(spark, sf)))
    return u.groupBy("source").agg(F.count("*").alias("n"))


@register("U2_dedup_feed_entries", sql=f"""
SELECT id, link FROM (SELECT coalesce(guid, link) AS id, link,
  row_number() OVER (PARTITION BY coalesce(guid, link) ORDER BY position, source_feed, link) AS rn
  FROM ({S.feed_entries()}) e) x WHERE rn = 1""")
def u2(spark, sf):
    e = A.feed_entries(spark, sf).withColumn("id", F.coalesce("guid", "link"))
    d = FE.dedup_first(e, "id", [F.col("position"), F.col("source_feed"), F.col("link")])
    return d.select("id", "link")


@register("U3_dedup_messages", sql=f"""
WITH n AS (SELECT * FROM ({discord_norm_sql()}) a UNION ALL SELECT * FROM ({discord_norm_sql()}) b WHERE message_id % 3 = 0)
SELECT DISTINCT id FROM n""")
def u3(spark, sf):
    n = N.normalize_discord(A.discord_messages(spark, sf))
    doubled = n.unionByName(n.where(F.col("message_id").cast("bigint") % 3 == 0))
    return FE.dedup_first(doubled, "id", [F.col("created_at").desc()]).select("id")


@register("J1_post_comments_join", sql=f"""
SELECT p.id AS post_id, count(c.id) AS n_comments FROM ({S.reddit_posts()}) p
JOIN ({S.reddit_comments()}) c ON c.post_id = p.id GROUP BY p.id""")
def j1(spark, sf):
    p = A.reddit_posts(spark, sf).select(F.col("id").alias("post_id"))
    c = A.reddit_comments(spark, sf).select("post_id", "id")
    return p.join(c, "post_id").groupBy("post_id").agg(F.count("id").alias("n_comments"))


@register("J5_monitored_semijoin", sql=f"""
SELECT message_id FROM ({S.discord_messages()}) m WHERE channel_id IN (
  SELECT channel_id FROM ({S.discord_messages()}) d WHERE {_monitored_sql()})""")
def j5(spark, sf):
    d = A.discord_messages(spark, sf)
    return FE.monitored_messages(d, d.select("channel_id", "channel_name").distinct()).select("message_id")


@register("J7_new_ids", sql="""
SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j7(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return FE.new_only(d, seen)


@register("J7_stored_seen_ids", sql="""
SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j7_stored(spark, sf):
    # a first run stores its ids in buckets; the second shuffles its own rows only
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    seen = SeenIds(spark, f"seen_{uuid.uuid4().hex[:12]}", d.schema["id"].dataType.simpleString())
    seen.add(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "first")
    return seen.new(d, "second")
