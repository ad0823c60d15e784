"""Registered queries: text scalars (T), validation (V), filters (F), weights (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions import validate as V
from ..sources import adapters as A
from ..sources.tables import table
from . import sql_adapters as S
from .registry import r6, register, ts_str

q = P.sql_literal


# --- T: text cleaning -----------------------------------------------------------

@register("T1_sanitize", sql=f"""
SELECT id, {S.sanitize('text')} AS clean FROM ({S.content(True)}) c""")
def t1(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", T.sanitize("text").alias("clean"))


@register("T2_replace_urls", sql=f"""
SELECT id, regexp_replace(text, {q(P.URL_TOKEN)}, '[URL]', 'g') AS out FROM ({S.content(True)}) c""")
def t2(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", T.replace_urls("text").alias("out"))


@register("T3_replace_mentions", sql=f"""
SELECT id, regexp_replace(text, {q(P.MENTION)}, '[USER]', 'g') AS out FROM ({S.content(True)}) c""")
def t3(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", T.replace_mentions("text").alias("out"))


@register("T4_collapse_repeats", sql=f"""
SELECT id, {S.collapse_repeats('text')} AS out FROM ({S.content(True)}) c""")
def t4(spark, sf):
    # the oracle has no back-references (RE2): it drops a character equal to
    # both predecessors, which is the same rewrite
    c = A.content(spark, sf, templated=True)
    return c.select("id", T.collapse_repeats("text").alias("out"))


@register("T5_social_preprocess", sql=S.social_preprocess())
def t5(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", T.social_preprocess("text").alias("out"))


def _discord_strip_sql(x):
    for pat in (P.DISCORD_USER, P.DISCORD_EVERYONE, P.DISCORD_CHANNEL, P.DISCORD_EMOJI):
        x = f"regexp_replace({x}, {q(pat)}, '', 'g')"
    return x


@register("T6_discord_markup", sql=f"""
SELECT message_id, {_discord_strip_sql('content')} AS out FROM ({S.discord_messages()}) d""")
def t6(spark, sf):
    d = A.discord_messages(spark, sf)
    return d.select("message_id", T.strip_discord_markup("content").alias("out"))


@register("T7_post_text", sql=f"""
SELECT id, {S.strip_ws("coalesce(title, '') || '. ' || coalesce(selftext, '')")} AS out
FROM ({S.reddit_posts()}) p""")
def t7(spark, sf):
    p = A.reddit_posts(spark, sf)
    return p.select("id", T.post_text("title", "selftext").alias("out"))


def summary_sql(x: str) -> str:
    s = S.strip_ws(f"array_to_string(list_slice(regexp_split_to_array(coalesce({x}, ''), '[.!?]+'), 1, 3), '. ')")
    return f"(SELECT CASE WHEN s <> '' AND NOT ends_with(s, '.') THEN s || '.' ELSE s END FROM (SELECT {s} AS s))"


@register("T8_summary", sql=f"""
SELECT doc_id AS id, {summary_sql('text')} AS summary FROM documents""")
def t8(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), T.summary("text").alias("summary"))


def word_count_sql(x: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array(coalesce({x}, ''), {q(P.WS_RUN)}), "
            f"lambda t: t <> '')) AS INTEGER)")


@register("T9_word_count", sql=f"""
SELECT doc_id AS id, {word_count_sql('text')} AS word_count,
       CAST({word_count_sql('text')} // 200 AS INTEGER) AS reading_time
FROM documents""")
def t9(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), T.word_count("text").alias("word_count"),
                    T.reading_time("text").alias("reading_time"))


AUTHORITY_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


@register("T10_url_host", sql=f"""
SELECT page_id, lower(regexp_extract(url, {q(AUTHORITY_RE)}, 1)) AS host FROM pages""")
def t10(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.url_host("url").alias("host"))


@register("T11_has_link", sql=f"""
SELECT message_id, coalesce(regexp_matches(content, {q(P.LINK)}), false) AS has_link
FROM ({S.discord_messages()}) d""")
def t11(spark, sf):
    d = A.discord_messages(spark, sf)
    return d.select("message_id", T.has_link("content").alias("has_link"))


@register("T12_case_fold", sql=f"""
SELECT id, regexp_matches(upper(text), '(^|[^A-Z])BTC') AS has_btc_upper,
       contains(lower(text), 'bitcoin') AS has_bitcoin_lower
FROM ({S.content(True)}) c""")
def t12(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", T.upper("text").rlike("(^|[^A-Z])BTC").alias("has_btc_upper"),
                    T.lower("text").contains("bitcoin").alias("has_bitcoin_lower"))


@register("T13_timestamps", sql=f"""
SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso,
       {S.fmt_ts("TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(1000 * id AS BIGINT))")} AS from_epoch
FROM ({S.content()}) c""")
def t13(spark, sf):
    c = A.content(spark, sf)
    iso = T.iso_format("created_at")
    return c.select("id", iso.alias("iso"),
                    ts_str(T.epoch_to_timestamp(F.lit(A.EPOCH_2024) + F.col("id") * 1000)).alias("from_epoch"))


# --- V: validation ------------------------------------------------------------------

def text_valid_sql(x):
    return f"coalesce(length({S.strip_ws(x)}) BETWEEN 1 AND 10000, false)"


@register("V1_text_valid", sql=f"""
SELECT id, {text_valid_sql('text')} AS raw_valid, {text_valid_sql(S.sanitize('text'))} AS clean_valid
FROM ({S.content()}) c""")
def v1(spark, sf):
    c = A.content(spark, sf)
    return c.select("id", V.text_valid("text").alias("raw_valid"),
                    V.text_valid(T.sanitize("text")).alias("clean_valid"))


def _allowed():
    return "[" + ", ".join(q(s) for s in V.vocab.ALLOWED_SOURCES) + "]"


@register("V2_source_valid", sql=f"""
SELECT d.doc_id AS id,
  coalesce(list_contains({_allowed()}, lower({S.strip_ws('d.source')})), false) AS raw_valid,
  coalesce(list_contains({_allowed()}, lower({S.strip_ws("'  ' || upper(c.source) || ' '")})), false) AS mapped_valid
FROM documents d JOIN ({S.content()}) c ON c.id = d.doc_id""")
def v2(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("raw"))
    c = A.content(spark, sf).select("id", "source")
    j = d.join(c, "id")
    return j.select("id", V.source_valid("raw").alias("raw_valid"),
                    V.source_valid(F.concat(F.lit("  "), F.upper("source"), F.lit(" "))).alias("mapped_valid"))


def lang_sql(x):
    return f"CASE WHEN {x} IS NULL THEN true ELSE regexp_matches(lower({S.strip_ws(x)}), '^[a-z]{{2}}(-[a-z]{{2}})?$') END"


@register("V3_language_valid", sql=f"""
SELECT doc_id AS id, {lang_sql('lang')} AS plain, {lang_sql("upper(lang) || '-US'")} AS region,
       {lang_sql("lang || '_x'")} AS bad
FROM documents""")
def v3(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), V.language_valid("lang").alias("plain"),
                    V.language_valid(F.concat(F.upper("lang"), F.lit("-US"))).alias("region"),
                    V.language_valid(F.concat("lang", F.lit("_x"))).alias("bad"))


@register("V4_symbol_valid", sql=f"""
SELECT doc_id AS id, split_part(text, ' ', 1) AS word,
       coalesce(regexp_matches(upper({S.strip_ws("split_part(text, ' ', 1)")}), '^[A-Z0-9]{{2,10}}$'), false) AS valid
FROM documents""")
def v4(spark, sf):
    d = table(spark, sf, "documents")
    w = F.split_part("text", F.lit(" "), F.lit(1))
    return d.select(F.col("doc_id").alias("id"), w.alias("word"), V.symbol_valid(w).alias("valid"))


@register("V5_time_range_valid", sql=f"""
SELECT event_id,
  coalesce(ts + to_days(CAST(event_id % 400 - 10 AS INTEGER)) > ts
    AND floor((epoch_us(ts + to_days(CAST(event_id % 400 - 10 AS INTEGER))) - epoch_us(ts)) / 86400000000) <= 365, false) AS valid
FROM ({S.request_log()}) r""")
def v5(spark, sf):
    r = A.request_log(spark, sf)
    end = F.col("ts") + F.make_dt_interval((F.col("event_id") % 400 - 10).cast("int"))
    return r.select("event_id", V.time_range_valid("ts", end).alias("valid"))


@register("V6_score_valid", sql=f"""
SELECT id, coalesce(value * 1.5 BETWEEN -1 AND 1 AND confidence BETWEEN 0 AND 1
   AND NOT isnan(value * 1.5) AND NOT isnan(confidence), false) AS valid
FROM ({S.stub_scores(S.content())}) s""")
def v6(spark, sf):
    s = A.stub_classifier_scores(A.content(spark, sf))
    return s.select("id", V.score_valid(F.col("value") * 1.5, "confidence").alias("valid"))


def _methods():
    return "[" + ", ".join(q(m) for m in V.vocab.HTTP_METHODS) + "]"


def _endpoint_sql(x):
    e = S.strip_ws(x)
    return f"CASE WHEN starts_with({e}, '/') THEN {e} ELSE '/' || {e} END"


@register("V7_request_valid", sql=f"""
SELECT event_id,
  coalesce(list_contains({_methods()}, upper({S.strip_ws("CASE WHEN event_id % 3 = 0 THEN ' ' || lower(method) ELSE method || 'X' END")}))
    AND regexp_matches({_endpoint_sql("CASE WHEN event_id % 2 = 0 THEN substring(endpoint, 2) ELSE endpoint || '?q' END")}, '^/[a-zA-Z0-9/_\\-\\.]*$'), false) AS valid
FROM ({S.request_log()}) r""")
def v7(spark, sf):
    r = A.request_log(spark, sf)
    m = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.lower("method"))) \
        .otherwise(F.concat("method", F.lit("X")))
    e = F.when(F.col("event_id") % 2 == 0, F.expr("substring(endpoint, 2)")) \
        .otherwise(F.concat("endpoint", F.lit("?q")))
    return r.select("event_id", V.request_valid(m, e).alias("valid"))


@register("V8_clean_batch", sql=f"""
SELECT id, length(t) AS n_chars FROM (
  SELECT id, {S.strip_ws("CASE WHEN id % 13 = 0 THEN '   ' ELSE text END")} AS t FROM ({S.content()}) c) x
WHERE t <> ''""")
def v8(spark, sf):
    c = A.content(spark, sf).select(
        "id", F.when(F.col("id") % 13 == 0, F.lit("   ")).otherwise(F.col("text")).alias("text"))
    out = V.clean_batch_texts(c)
    return out.select("id", F.length("text").alias("n_chars"))


# --- F: filters -----------------------------------------------------------------------

@register("F1_min_length", sql=f"""
SELECT 'tweet' AS kind, count(*) AS n FROM ({S.tweets()}) t WHERE length({S.sanitize('text')}) >= 10
UNION ALL SELECT 'comment', count(*) FROM ({S.reddit_comments()}) c WHERE length(body) >= 5
UNION ALL SELECT 'post', count(*) FROM ({S.reddit_posts()}) p WHERE length(selftext) >= 10
UNION ALL SELECT 'article', count(*) FROM documents WHERE length(text) >= 100""")
def f1(spark, sf):
    tw = A.tweets(spark, sf).where(V.min_length(T.sanitize("text"), 10))
    cm = A.reddit_comments(spark, sf).where(V.min_length("body", 5))
    po = A.reddit_posts(spark, sf).where(V.min_length("selftext", 10))
    ar = table(spark, sf, "documents").where(V.min_length("text", 100))
    parts = [tw.select(F.lit("tweet").alias("kind")), cm.select(F.lit("comment").alias("kind")),
             po.select(F.lit("post").alias("kind")), ar.select(F.lit("article").alias("kind"))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("kind").agg(F.count("*").alias("n"))


@register("F2_tombstones", sql=f"""
SELECT id FROM ({S.reddit_comments()}) c WHERE body NOT IN ('[deleted]', '[removed]')""")
def f2(spark, sf):
    return A.reddit_comments(spark, sf).where(V.not_tombstone("body")).select("id")


@register("F3_bots", sql=f"""
SELECT message_id FROM ({S.discord_messages()}) d WHERE NOT coalesce(author_is_bot, false)""")
def f3(spark, sf):
    return A.discord_messages(spark, sf).where(V.not_bot("author.is_bot")).select("message_id")


@register("F4_recent", sql=f"""
SELECT id FROM ({S.content()}) c WHERE created_at > TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 6 HOUR""")
def f4(spark, sf):
    c = A.content(spark, sf)
    return c.where(V.recent("created_at", "2024-01-01 12:00:00", 6)).select("id")


@register("F6_confident", sql=f"""
SELECT id FROM ({S.stub_scores(S.content())}) s WHERE confidence > 0.1""")
def f6(spark, sf):
    s = A.stub_classifier_scores(A.content(spark, sf))
    return s.where(V.confident("confidence")).select("id")


# --- W: weights --------------------------------------------------------------------

_W_SQL = f"""
WITH s AS (SELECT id, source FROM ({S.content()}) c),
w AS (SELECT id, CASE
   WHEN source IN ('twitter','reddit','telegram','discord') THEN MAP {{'finbert': 0.3, 'vader': 0.4, 'textblob': 0.1, 'crypto_specific': 0.2}}
   WHEN source = 'news' THEN MAP {{'finbert': 0.5, 'vader': 0.2, 'textblob': 0.1, 'crypto_specific': 0.2}}
   ELSE MAP {{'finbert': 0.4, 'vader': 0.2, 'textblob': 0.2, 'crypto_specific': 0.2}} END AS m,
   (id % 4) * 0.25 AS scale FROM s)
"""


def _weights_frame(spark, sf):
    c = A.content(spark, sf).select("id", "source")
    from ..operators.ensemble import top_level_weights_map
    return c.select("id", top_level_weights_map(F.col("source")).alias("m"),
                    ((F.col("id") % 4) * 0.25).alias("scale"))


@register("W1_weights_valid", sql=_W_SQL + """
SELECT id, coalesce(
  len(map_values(mm)) > 0 AND list_bool_and(list_transform(map_values(mm), lambda v: v IS NOT NULL AND v >= 0))
  AND list_sum(map_values(mm)) BETWEEN 0.95 AND 1.05, false) AS valid
FROM (SELECT id, map_from_entries(list_transform(map_entries(m), lambda e: {'key': e.key, 'value': e.value * scale})) AS mm FROM w) x""")
def w1(spark, sf):
    w = _weights_frame(spark, sf)
    mm = F.transform_values("m", lambda k, v: v * F.col("scale"))
    return w.select("id", V.weights_valid(mm).alias("valid"))


@register("W2_normalize_weights", sql=_W_SQL + """
SELECT id, round(mm['vader'] / t, 6) AS vader, round(mm['finbert'] / t, 6) AS finbert, t = 0 AS was_zero
FROM (SELECT id, mm, list_sum(map_values(mm)) AS t FROM (SELECT id, map_from_entries(list_transform(map_entries(m),
   lambda e: {'key': e.key, 'value': e.value * scale})) AS mm FROM w) x) y WHERE t <> 0
UNION ALL
SELECT id, 0.25, 0.25, true FROM w WHERE scale = 0""")
def w2(spark, sf):
    w = _weights_frame(spark, sf)
    mm = F.transform_values("m", lambda k, v: v * F.col("scale"))
    n = V.normalize_weights(mm)
    return w.select("id", r6(n["vader"]).alias("vader"), r6(n["finbert"]).alias("finbert"),
                    (F.col("scale") == 0).alias("was_zero"))


@register("C1_weights_json", sql="""
SELECT doc_id AS id, round(CAST(json_extract(j, '$.vader') AS DOUBLE), 6) AS vader FROM (
  SELECT doc_id, '{"finbert": 0.4, "vader": ' || CAST((doc_id % 10) / 10.0 AS VARCHAR) || '}' AS j FROM documents) x""")
def c1(spark, sf):
    d = table(spark, sf, "documents")
    j = F.concat(F.lit('{"finbert": 0.4, "vader": '), ((F.col("doc_id") % 10) / 10.0).cast("string"), F.lit("}"))
    return d.select(F.col("doc_id").alias("id"), r6(V.weights_from_json(j)["vader"]).alias("vader"))
