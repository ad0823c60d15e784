"""Registered queries: HTML extraction and the news path (H1-H3, S5, S6, N1,
J2, K1, K2, K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles as AR
from ..operators import fetch as FE
from ..sources import adapters as A
from ..sources.tables import table
from . import sql_adapters as S
from .registry import r6, register, ts_str

AS_OF = "2024-05-01 00:00:00"
HOURS = 24 * 200          # window covering every fixture entry
SEARCH_KEYWORDS = ["the", "und", "que", "para"]


def _news(spark, sf):
    # data vocabulary (FIXTURES.md 3a): the default crypto lists never occur
    # in the invented prose, which would make the path an empty result
    from .q_mentions import DATA_KEYWORDS, DATA_SYMBOLS
    return AR.news_articles(A.feed_entries(spark, sf), table(spark, sf, "pages", even=False), AS_OF,
                            hours_back=HOURS, keywords=DATA_KEYWORDS, symbols=DATA_SYMBOLS)


@register("H1_H3_extract_pages")
def h13(spark, sf):
    # bodies have no SQL oracle (HTML tree semantics); goldens in tests/
    ex = AR.extract_articles(table(spark, sf, "pages"))
    return ex.select("page_id", "title", F.length("text").alias("text_chars"),
                     F.size(F.split("text", "\n")).alias("n_parts"), "summary")


def _decode(x):
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"),
                    ("&amp;", "&")]:
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return x


@register("H2_titles", sql=f"""
SELECT page_id, {S.strip_ws(_decode("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS title FROM pages""")
def h2(spark, sf):
    ex = AR.extract_articles(table(spark, sf, "pages"))
    return ex.select("page_id", "title")


@register("S5_feed_entries", sql=f"""
SELECT coalesce(guid, link, '') AS id, link,
  lower(regexp_extract(source_feed, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)) AS source_domain,
  {S.fmt_ts('published_at')} AS published_at
FROM ({S.feed_entries()}) e""")
def s5(spark, sf):
    e = AR.feed_entries(A.feed_entries(spark, sf))
    return e.select("id", "link", "source_domain", ts_str("published_at").alias("published_at"))


@register("S5_landed_xml", sql=f"""
SELECT coalesce(guid, link, '') AS id, link,
  lower(regexp_extract(source_feed, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)) AS source_domain,
  {S.fmt_ts('published_at')} AS published_at
FROM ({S.feed_entries()}) e""")
def s5_xml(spark, sf):
    # the entries are landed as raw RSS items, then read and parsed like a fetched feed
    from ..streaming.streams import scratch
    e = A.feed_entries(spark, sf)
    items = e.select("guid", "title", F.col("summary").alias("description"), "link",
                     F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"),
                     F.col("source_feed").alias("source"), "position")
    path = scratch(spark, "s5-xml")
    items.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    out = AR.feed_entries(AR.landed_feed(spark, path))
    return out.select("id", "link", "source_domain", ts_str("published_at").alias("published_at"))


@register("K2_per_feed_cap", sql=f"""
WITH e AS (SELECT coalesce(guid, link, '') AS id, link, source_feed, position FROM ({S.feed_entries()}) e0),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position, source_feed, link) AS rn FROM e) x WHERE rn = 1)
SELECT id, source_feed FROM (SELECT *, row_number() OVER (PARTITION BY source_feed ORDER BY position, link) AS rk FROM d) y
WHERE rk <= 20""")
def k2(spark, sf):
    e = AR.feed_entries(A.feed_entries(spark, sf))
    e = FE.dedup_first(e, "id", [F.col("position"), F.col("source_feed"), F.col("link")])
    return FE.top_n_per_key(e, ["source_feed"], [F.col("position"), F.col("link")], 20) \
        .select("id", "source_feed")


@register("J2_entry_page_join", sql=f"""
SELECT e.source_feed, count(*) AS n_pages, sum(length(p.html)) AS html_chars
FROM ({S.feed_entries()}) e JOIN pages p ON p.url = e.link GROUP BY e.source_feed""")
def j2(spark, sf):
    e = A.feed_entries(spark, sf)
    j = e.join(AR.linked_pages(table(spark, sf, "pages", even=False), e), "link")
    return j.groupBy("source_feed").agg(F.count("*").alias("n_pages"),
                                        F.sum(F.length("html")).alias("html_chars"))


@register("S6_N1_news_articles")
def s6(spark, sf):
    a = _news(spark, sf)
    return a.select("id", "title", "url", F.size("symbols_mentioned").alias("n_symbols"),
                    r6("metrics.relevance_score").alias("relevance"), "metrics.word_count",
                    "metadata.source_type")


@register("K1_latest_news")
def k1(spark, sf):
    # top-k report: the limit is the feature
    a = AR.latest_news(_news(spark, sf), limit=25, min_relevance=0.1)
    return a.select("id", r6("metrics.relevance_score").alias("relevance"),
                    ts_str("published_at").alias("published_at"))


@register("K4_search_news")
def k4(spark, sf):
    a = AR.search_news(_news(spark, sf), SEARCH_KEYWORDS, limit=20, hours_back=None)
    return a.select("id", r6("keyword_relevance").alias("keyword_relevance"))


@register("K4_search_news_week")
def k4_week(spark, sf):
    # the week up to the newest entry
    newest = A.feed_entries(spark, sf).agg(F.max("published_at")).first()[0]
    a = AR.search_news(_news(spark, sf), SEARCH_KEYWORDS, limit=20, as_of=newest)
    return a.select("id", r6("keyword_relevance").alias("keyword_relevance"))
