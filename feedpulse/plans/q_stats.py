"""Registered queries: searches (K3, K5-K7), aggregates and statistics
(A1, A3-A8, A10), request-log analyses (A12-A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import mentions as M
from ..functions import text as T
from ..operators import aggregate as AG
from ..operators import articles as AR
from ..operators import classify as C
from ..operators import lexicon as L
from ..operators import normalize as N
from ..operators import ratelimit as RL
from ..operators import search as SE
from ..operators.textindex import TextIndex
from ..sources import adapters as A
from . import q_models as QM
from . import q_sources as QS
from . import sql_adapters as S
from . import sql_models as SM
from . import sql_text as ST
from .registry import r6, register, ts_str

q = S.q


# --- K: searches --------------------------------------------------------------------

@register("K3_top_posts", sql=f"""
SELECT id, subreddit FROM (SELECT id, subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, id) AS rn
FROM ({S.reddit_posts()}) p) x WHERE rn <= 10""")
def k3(spark, sf):
    return SE.top_posts(A.reddit_posts(spark, sf)).select("id", "subreddit")


@register("K5_search_discord", sql=f"""
WITH m AS (SELECT * FROM ({S.discord_messages()}) m0
      WHERE channel_id IN (SELECT channel_id FROM ({S.discord_messages()}) d WHERE {QS._monitored_sql()})
      AND created_at > TIMESTAMP '{QS.AS_OF}' - INTERVAL {QS.WIDE_HOURS} HOUR),
n AS (SELECT * FROM (SELECT CAST(guild_id AS VARCHAR) || '_' || CAST(channel_id AS VARCHAR) || '_' || CAST(message_id AS VARCHAR) AS id,
        created_at, {S.sanitize(QS._discord_strip_sql('content'))} AS clean
      FROM m WHERE content IS NOT NULL AND content <> '' AND length(content) >= 5) x
      WHERE length(clean) >= 1 AND {ST.relevant('clean', 'discord')})
SELECT id FROM (SELECT DISTINCT id, created_at FROM n WHERE contains(lower(clean), 'the')) y
ORDER BY created_at DESC, id DESC LIMIT 100""")
def k5(spark, sf):
    d = A.discord_messages(spark, sf)
    dims = d.select("channel_id", "channel_name").distinct()
    r = SE.search_discord(d, dims, "the", QS.AS_OF, hours_back=QS.WIDE_HOURS)
    return r.select("id")


@register("K6_search_telegram", sql=f"""
WITH n AS (SELECT * FROM (SELECT channel || '_' || CAST(message_id AS VARCHAR) AS id, date AS created_at,
        {S.sanitize('text')} AS clean FROM ({S.telegram_messages()}) m0
        WHERE contains(lower(text), 'the') AND text <> '' AND length(text) >= 5) x
      WHERE length(clean) >= 1)
SELECT id FROM n ORDER BY created_at DESC, id DESC LIMIT 60""")
def k6(spark, sf):
    chans = [f"@ch{i}" for i in range(6)]
    return SE.search_telegram(A.telegram_messages(spark, sf), "the", chans, limit=60).select("id")


def _k7_sql():
    low = "lower(concat_ws(' ', title, selftext))"
    return f"""
WITH p AS (SELECT *, CAST(contains({low}, 'the') AS INTEGER) + CAST(contains({low}, 'and') AS INTEGER) AS hits
           FROM ({S.reddit_posts()}) p0),
t AS (SELECT * FROM p WHERE hits > 0 ORDER BY hits DESC, score DESC, id LIMIT 30),
n AS (SELECT id, {S.sanitize('full_text')} AS clean FROM (SELECT *, {S.strip_ws("coalesce(title, '') || '. ' || coalesce(selftext, '')")} AS full_text FROM t) x
      WHERE length(full_text) >= 10)
SELECT id FROM n WHERE length(clean) >= 1"""


@register("K7_search_reddit", sql=_k7_sql())
def k7(spark, sf):
    r = SE.search_reddit(A.reddit_posts(spark, sf), "the and", limit=30, sort="relevance", time_filter="all")
    return r.select("id")


# --- K5-K7 over the stored trigram index ----------------------------------------------------

# FIXED VALUES: search words that occur in the invented prose
INDEXED_PHRASE, INDEXED_TERMS = "able", ["sich", "pour"]


@register("K5_indexed_search", sql=f"""
WITH n AS (SELECT id, {S.sanitize('text')} AS clean FROM ({S.content()}) c)
SELECT id FROM n WHERE contains(lower(clean), {q(INDEXED_PHRASE)})""")
def k5_indexed(spark, sf):
    # all cleaned content, every match
    c = A.content(spark, sf).select("id", T.sanitize("text").alias("text"))
    return TextIndex(spark, c.schema).add(c).matching(INDEXED_PHRASE).select("id")


@register("K6_indexed_search", sql=f"""
WITH n AS (SELECT * FROM (SELECT channel || '_' || CAST(message_id AS VARCHAR) AS id, date AS created_at,
        {S.sanitize('text')} AS clean FROM ({S.telegram_messages()}) m0
        WHERE contains(lower(text), {q(INDEXED_PHRASE)}) AND text <> '' AND length(text) >= 5) x
      WHERE length(clean) >= 1)
SELECT id FROM n ORDER BY created_at DESC, id DESC LIMIT 60""")
def k6_indexed(spark, sf):
    m = A.telegram_messages(spark, sf)
    found = TextIndex(spark, m.schema).add(m).matching(INDEXED_PHRASE)
    return SE.search_telegram(found, INDEXED_PHRASE, [f"@ch{i}" for i in range(6)], limit=60).select("id")


@register("K7_indexed_search", sql=f"""
SELECT id FROM ({S.reddit_posts()}) p
WHERE {' OR '.join(f"contains(lower(concat_ws(' ', title, selftext)), {q(t)})" for t in INDEXED_TERMS)}""")
def k7_indexed(spark, sf):
    # any of the terms in title or body, every match
    p = A.reddit_posts(spark, sf).select("id", F.concat_ws(" ", "title", "selftext").alias("text"))
    return TextIndex(spark, p.schema).add(p).matching_any(INDEXED_TERMS).select("id")


# --- A1: weighted multi-source aggregation ----------------------------------------------

def _a1_spark(spark, sf):
    c = A.content(spark, sf, templated=True)
    men = F.array().cast("array<string>")
    for d in M.DIALECTS:
        men = F.when(F.col("source") == d, M.mentions("text", d)).otherwise(men)
    # a generator of one element, so that the mentions are computed once: the explode that follows adds a filter, which
    # the optimizer would push down with the whole expression in it, twice beside the column itself
    c = c.withColumn("symbols_mentioned", F.explode(F.array(men)))
    # the mention array rides through the lexicon job as a carried column
    return L.lexicon_score(c, L.default_lexicon(spark), keep=["source", "created_at", "symbols_mentioned"])


def _a1_sql_base():
    men = " ".join(f"WHEN source = {q(d)} THEN {ST.mentions_list('text', d)}" for d in M.DIALECTS)
    lex = SM.lexicon_scores(S.content(True), QM.TPL_ENTRIES, vocab.NEGATORS, ["source", "created_at"])
    w = AG.DEFAULT_SOURCE_WEIGHTS
    tot = sum(w.values())
    wexpr = "CASE " + " ".join(f"WHEN source = {q(k)} THEN {v / tot!r}" for k, v in w.items()) + " ELSE 0.0 END"
    return f"""
WITH m AS (SELECT id, CASE {men} ELSE CAST([] AS VARCHAR[]) END AS syms FROM ({S.content(True)}) c),
s AS ({lex}),
x AS (SELECT s.*, unnest(m.syms) AS symbol, {wexpr} AS w FROM s JOIN m ON m.id = s.id)"""


@register("A1_aggregate_sentiment", sql=_a1_sql_base() + """
SELECT symbol, round(CASE WHEN sum(w * confidence) > 0 THEN sum(w * confidence * value) / sum(w * confidence) ELSE 0.0 END, 6) AS sentiment,
       round(CASE WHEN sum(w) > 0 THEN sum(w * confidence) / sum(w) ELSE 0.0 END, 6) AS confidence,
       count(*) AS n_items
FROM x GROUP BY symbol""")
def a1(spark, sf):
    g = AG.aggregate_sentiment(_a1_spark(spark, sf))
    return g.select("symbol", r6("sentiment").alias("sentiment"), r6("confidence").alias("confidence"), "n_items")


@register("A1_windowed_sentiment", sql=_a1_sql_base() + """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, created_at), '%Y-%m-%d %H:%M:%S') AS window_start, symbol,
       round(CASE WHEN sum(w * confidence) > 0 THEN sum(w * confidence * value) / sum(w * confidence) ELSE 0.0 END, 6) AS sentiment,
       count(*) AS n_items
FROM x GROUP BY 1, 2""")
def a1w(spark, sf):
    g = AG.aggregate_sentiment(_a1_spark(spark, sf), window="1 hour")
    return g.select(ts_str("window.start").alias("window_start"), "symbol",
                    r6("sentiment").alias("sentiment"), "n_items")


# --- A3-A8, A10 ----------------------------------------------------------------------

def _union_sql():
    return f"""
SELECT id, 'twitter' AS source, NULL AS channel FROM ({QS.tweets_norm_sql()}) a WHERE length(clean) >= 10
UNION ALL SELECT id, 'reddit', subreddit FROM ({QS.posts_norm_sql()}) b
UNION ALL SELECT id, 'reddit', NULL FROM ({QS.comments_norm_sql()}) c
UNION ALL SELECT id, 'telegram', channel FROM ({QS.telegram_norm_sql()}) d
UNION ALL SELECT id, 'discord', channel_name FROM ({QS.discord_norm_sql()}) e"""


def _union_spark(spark, sf):
    u = N.union_content(N.normalize_tweets(A.tweets(spark, sf)),
                        N.normalize_posts(A.reddit_posts(spark, sf)),
                        N.normalize_comments(A.reddit_comments(spark, sf)),
                        N.normalize_telegram(A.telegram_messages(spark, sf)),
                        N.normalize_discord(A.discord_messages(spark, sf)))
    return u.withColumn("channel", F.coalesce("channel", "channel_name", "subreddit"))


@register("A3_source_stats", sql=f"""
SELECT source, count(*) AS items, count(DISTINCT id) AS seen_ids, count(DISTINCT channel) AS channels
FROM ({_union_sql()}) u GROUP BY source""")
def a3(spark, sf):
    return AG.source_stats(_union_spark(spark, sf), channel_col="channel")


@register("A4_model_stats", sql=f"""
SELECT model, count(*) AS predictions, count(*) FILTER (WHERE NOT ok) AS failures,
       least(count(*) FILTER (WHERE ok), 100) AS history_length
FROM ({QM._score_rows_sql()}) s GROUP BY model""")
def a4(spark, sf):
    return AG.model_stats(QM.score_rows(spark, sf))


@register("A3_news_stats", sql=f"""
WITH e AS (SELECT coalesce(guid, link, '') AS id, link, source_feed, published_at,
  lower(regexp_extract(source_feed, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)) AS domain,
  CASE WHEN guid IS NULL THEN 'entry without an id: ' || link END AS error FROM ({S.feed_entries()}) f)
SELECT 'news' AS source, count(*) AS items, count(DISTINCT id) AS seen_ids, count(DISTINCT domain) AS domains,
  count(DISTINCT source_feed) AS feeds,
  last(error ORDER BY published_at, id) FILTER (WHERE error IS NOT NULL) AS last_error
FROM e HAVING count(*) > 0""")
def a3_news(spark, sf):
    e = AR.feed_entries(A.feed_entries(spark, sf)).withColumn("source", F.lit("news")) \
        .withColumn("error", F.when(F.col("id") == F.col("link"), F.concat(F.lit("entry without an id: "), "link")))
    return AG.source_stats(e, domain_col="source_domain", feed_col="source_feed", error_col="error", ts_col="published_at")


@register("A4_model_run_stats", sql=f"""
WITH s AS (SELECT model, ok, false AS timed FROM ({SM.lexicon_scores(S.content(True), QM.TPL_ENTRIES, vocab.NEGATORS, [])}) l, (SELECT 'vader' AS model) m
  UNION ALL SELECT model, ok, ok FROM ({SM.stub_classifier(QM.FINBERT_TEXTS, "finbert")}) f)
SELECT model, count(*) AS predictions, count(*) FILTER (WHERE NOT ok) AS failures,
  least(count(*) FILTER (WHERE ok), 100) AS history_length, bool_or(timed) AS timed,
  CASE WHEN model = 'vader' THEN {len(QM.TPL_ENTRIES)} END AS lexicon_size
FROM s GROUP BY model""")
def a4_run(spark, sf):
    # a run of both models with what it took; times differ from run to run, so only their presence is reported
    c = A.content(spark, sf, templated=True)
    lexicon = L.default_lexicon(spark)
    vader = L.lexicon_score(c, lexicon).select(F.col("model_name").alias("model"), "ok", F.lit(None).cast("double").alias("inference_ms"))
    finbert = C.classifier_scores(c, C.KeywordStubModel, model_name="finbert", details=True).select("model", "ok", "inference_ms")
    stats = AG.model_stats(vader.unionByName(finbert), time_col="inference_ms", lexicon_sizes={"vader": lexicon.count()})
    return stats.select("model", "predictions", "failures", "history_length", (F.col("avg_inference_ms") > 0).alias("timed"), "lexicon_size")


@register("A5_stats_report", sql=f"""
WITH a3 AS (SELECT source, count(*) AS items, count(DISTINCT id) AS seen_ids FROM ({_union_sql()}) u GROUP BY source),
a4 AS (SELECT model, count(*) AS predictions, count(*) FILTER (WHERE NOT ok) AS failures FROM ({QM._score_rows_sql()}) s GROUP BY model)
SELECT 'source' AS entity, source AS name, 'items' AS metric, CAST(items AS DOUBLE) AS value FROM a3
UNION ALL SELECT 'source', source, 'seen_ids', CAST(seen_ids AS DOUBLE) FROM a3
UNION ALL SELECT 'model', model, 'predictions', CAST(predictions AS DOUBLE) FROM a4
UNION ALL SELECT 'model', model, 'failures', CAST(failures AS DOUBLE) FROM a4""")
def a5(spark, sf):
    s3 = AG.source_stats(_union_spark(spark, sf))
    s4 = AG.model_stats(QM.score_rows(spark, sf)).select("model", "predictions", "failures")
    return AG.stats_report(("source", s3, "source"), ("model", s4, "model"))


@register("A6_request_counts", sql=f"""
SELECT method, endpoint, status, count(*) AS requests FROM ({S.request_log()}) r GROUP BY 1, 2, 3""")
def a6(spark, sf):
    return AG.request_counts(A.request_log(spark, sf))


@register("A7_prediction_counts", sql=f"""
SELECT model, source, count(*) AS predictions FROM ({QM._score_rows_sql()}) s GROUP BY 1, 2""")
def a7(spark, sf):
    return AG.prediction_counts(QM.score_rows(spark, sf))


def _a8_sql():
    parts = []
    for b in AG.DEFAULT_BUCKETS:
        parts.append(f"""SELECT method, endpoint, '{b}' AS le, count(*) FILTER (WHERE duration_ms / 1000.0 <= {b}) AS count,
   round(sum(duration_ms / 1000.0), 6) AS sum_seconds FROM ({S.request_log()}) r GROUP BY 1, 2""")
    parts.append(f"""SELECT method, endpoint, '+Inf', count(*), round(sum(duration_ms / 1000.0), 6)
   FROM ({S.request_log()}) r GROUP BY 1, 2""")
    return "\nUNION ALL\n".join(parts)


@register("A8_duration_histogram", sql=_a8_sql())
def a8(spark, sf):
    h = AG.duration_histogram(A.request_log(spark, sf))
    return h.select("method", "endpoint", "le", "count", r6("sum_seconds").alias("sum_seconds"))


@register("A10_event_metrics", sql=f"""
SELECT event_type, count(*) AS events, round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms,
       max(duration_ms) AS max_ms
FROM ({S.request_log()}) r GROUP BY 1""")
def a10(spark, sf):
    m = AG.event_metrics(A.request_log(spark, sf))
    return m.select("event_type", "events", r6("avg_ms").alias("avg_ms"), "min_ms", "max_ms")


def _pct_sql():
    cols = ",\n  ".join(
        f"max(CASE WHEN rn = greatest(CAST(ceil({p} * n) AS BIGINT), 1) THEN duration_ms END) AS {name}"
        for p, name in [(0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")])
    return f"""
WITH r AS (SELECT event_type, duration_ms,
  row_number() OVER (PARTITION BY event_type ORDER BY duration_ms) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM ({S.request_log()}) x)
SELECT event_type,
  {cols}
FROM r GROUP BY event_type"""


@register("A10_event_percentiles", sql=_pct_sql())
def a10p(spark, sf):
    return AG.event_percentiles(A.request_log(spark, sf))


# --- A12-A14: request-log sequences ----------------------------------------------------

@register("A12_rate_check", sql=f"""
SELECT event_id, in_window, in_window > 2 AS throttled FROM (
  SELECT event_id, count(*) OVER (PARTITION BY key ORDER BY epoch_us(ts)
         RANGE BETWEEN {15 * 60 * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS in_window
  FROM ({S.request_log()}) r) x""")
def a12(spark, sf):
    r = RL.rate_check(A.request_log(spark, sf), window_seconds=900, limit=2)
    return r.select("event_id", "in_window", "throttled")


@register("A13_min_gap", sql=f"""
SELECT event_id, round(gap, 6) AS gap_seconds, coalesce(gap < 60.0, false) AS too_soon FROM (
  SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id))) / 1e6 AS gap
  FROM ({S.request_log()}) r) x""")
def a13(spark, sf):
    r = RL.min_gap_check(A.request_log(spark, sf), min_interval_seconds=60.0)
    return r.select("event_id", r6("gap_seconds").alias("gap_seconds"), "too_soon")


@register("A14_failure_runs", sql=f"""
WITH r AS (SELECT key, ts, event_id, is_failure,
   sum(CASE WHEN is_failure THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id
   FROM ({S.request_log()}) x),
f AS (SELECT *, row_number() OVER (PARTITION BY key, run_id ORDER BY ts, event_id) AS idx FROM r WHERE is_failure)
SELECT key, run_id, count(*) AS n_failures, {S.fmt_ts('min(ts)')} AS first_failure,
       {S.fmt_ts('max(ts)')} AS last_failure, {S.fmt_ts('min(CASE WHEN idx = 3 THEN ts END)')} AS opened_at,
       {S.fmt_ts("max(ts) + INTERVAL 60 SECOND")} AS retry_at
FROM f GROUP BY key, run_id HAVING count(*) >= 3""")
def a14(spark, sf):
    r = RL.failure_runs(A.request_log(spark, sf), threshold=3)
    return r.select("key", "run_id", "n_failures", ts_str("first_failure").alias("first_failure"),
                    ts_str("last_failure").alias("last_failure"), ts_str("opened_at").alias("opened_at"),
                    ts_str("retry_at").alias("retry_at"))


@register("A14_outages_default", sql=f"""
WITH r AS (SELECT key, ts, event_id, is_failure,
   sum(CASE WHEN is_failure THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id
   FROM ({S.request_log()}) x)
SELECT key, run_id, count(*) AS n_failures FROM r WHERE is_failure GROUP BY key, run_id HAVING count(*) >= 5""")
def a14d(spark, sf):
    r = RL.failure_runs(A.request_log(spark, sf))
    return r.select("key", "run_id", "n_failures")
