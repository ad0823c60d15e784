"""Registered queries: mentions, relevance, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import mentions as M
from ..functions import text as T
from ..operators import keywords as K
from ..sources import adapters as A
from . import sql_adapters as S
from . import sql_text as ST
from .registry import arr_str, r6, register

DIALECTS = M.DIALECTS
# FIXED VALUES: data vocabulary that occurs in the invented prose (FIXTURES.md 3a)
DATA_SYMBOLS = ["THAT", "WITH", "FROM", "THIN", "DER", "UND", "LES", "QUE"]
DATA_KEYWORDS = ["able", "sich", "pour", "para"]


def _mentions_cols_sql(x, symbols=vocab.CRYPTO_SYMBOLS):
    return ", ".join(f"{ST.mentions_str(x, d, symbols)} AS {d}" for d in DIALECTS)


@register("X1_mentions_by_dialect", sql=f"""
SELECT id, {_mentions_cols_sql('text')} FROM ({S.content(True)}) c""")
def x1(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", *[F.array_join(M.mentions("text", d), ",").alias(d) for d in DIALECTS])


@register("X1_mentions_data_vocab", sql=f"""
SELECT id, {ST.mentions_str('text', 'reddit', DATA_SYMBOLS)} AS symbols FROM ({S.content()}) c""")
def x1d(spark, sf):
    c = A.content(spark, sf)
    return c.select("id", F.array_join(M.mentions("text", "reddit", DATA_SYMBOLS), ",").alias("symbols"))


def _rel_cols_sql(x):
    return ", ".join(f"{ST.relevant(x, d)} AS {d}" for d in DIALECTS)


@register("X2_relevance_by_dialect", sql=f"""
SELECT id, {_rel_cols_sql('text')} FROM ({S.content(True)}) c""")
def x2(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", *[M.relevant("text", d).alias(d) for d in DIALECTS])


@register("X2_relevance_data_vocab", sql=f"""
SELECT id, {ST.relevant('text', 'twitter', DATA_KEYWORDS, DATA_SYMBOLS)} AS relevant FROM ({S.content()}) c""")
def x2d(spark, sf):
    c = A.content(spark, sf)
    return c.select("id", M.relevant("text", "twitter", DATA_KEYWORDS, DATA_SYMBOLS).alias("relevant"))


def _kw_array_sql(x):
    per = [f"CASE WHEN contains(lower({x}), {S.q(k)}) THEN {S.q(k)} END" for k in vocab.CRYPTO_KEYWORDS]
    return f"list_filter([{', '.join(per)}], lambda x: x IS NOT NULL)"


@register("X0_keyword_doc_counts", sql=f"""
SELECT keyword, count(*) AS n_docs FROM (
  SELECT unnest({_kw_array_sql('text')}) AS keyword FROM ({S.content(True)}) c) x GROUP BY keyword""")
def x0(spark, sf):
    c = A.content(spark, sf, templated=True)
    low = F.lower("text")
    per = [F.when(low.contains(k), F.lit(k)) for k in vocab.CRYPTO_KEYWORDS]
    hits = F.array_except(F.array(*per), F.array(F.lit(None).cast("string")))
    return (c.select(F.explode(hits).alias("keyword")).groupBy("keyword")
             .agg(F.count("*").alias("n_docs")))


@register("X3_platform_patterns", sql="SELECT id, " + ", ".join(
    f"coalesce(regexp_matches(lower(text), {S.q(M.platform_pattern(d))}), false) AS {d}"
    for d in ["reddit", "news", "telegram", "discord"]) + f" FROM ({S.content(True)}) c")
def x3(spark, sf):
    c = A.content(spark, sf, templated=True)
    return c.select("id", *[F.coalesce(F.lower("text").rlike(M.platform_pattern(d)), F.lit(False)).alias(d)
                            for d in ["reddit", "news", "telegram", "discord"]])


def _article_like(spark, sf):
    """Articles from content: first sentence as title, a specialised domain
    for every fifth row."""
    c = A.content(spark, sf, templated=True)
    url = F.concat(F.lit("https://"),
                   F.when(F.col("id") % 5 == 0, F.lit("www.cointelegraph.com")).otherwise(F.lit("news.example.org")),
                   F.lit("/a/"), F.col("id").cast("string"))
    return c.select("id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), "text", url.alias("url"))


_ARTICLE_SQL = f"""SELECT id, split_part(text, '.', 1) AS title, text,
  'https://' || CASE WHEN id % 5 = 0 THEN 'www.cointelegraph.com' ELSE 'news.example.org' END || '/a/' || CAST(id AS VARCHAR) AS url
  FROM ({S.content(True)}) c"""


@register("X4_relevance_score", sql=f"""
SELECT id, {S.r6(ST.relevance_score('title', 'text', 'url'))} AS relevance FROM ({_ARTICLE_SQL}) a""")
def x4(spark, sf):
    a = _article_like(spark, sf)
    return a.select("id", r6(M.news_relevance_score("title", "text", "url")).alias("relevance"))


@register("X5_classify_source", sql=f"""
SELECT page_id, {ST.classify_source(ST.authority('url'))} AS page_class,
       {ST.classify_source(ST.authority(S.arr(vocab.ALL_FEEDS) + f'[page_id % {len(vocab.ALL_FEEDS)} + 1]'))} AS feed_class
FROM pages""")
def x5(spark, sf):
    from ..sources.tables import table
    p = table(spark, sf, "pages")
    feeds = F.array(*[F.lit(u) for u in vocab.ALL_FEEDS])
    feed = F.element_at(feeds, (F.col("page_id") % len(vocab.ALL_FEEDS) + 1).cast("int"))
    return p.select("page_id", M.classify_source(T.url_host("url")).alias("page_class"),
                    M.classify_source(T.url_host(feed)).alias("feed_class"))


@register("X6_search_symbols", sql=f"""
SELECT id, unnest({ST.search_symbols('text')}) AS symbol FROM ({S.tweets()}) t""")
def x6(spark, sf):
    t = A.tweets(spark, sf)
    return t.select("id", F.explode(M.search_symbols("text")).alias("symbol"))


def _dialect_mentions(text_col="text", source_col="source"):
    out = F.array().cast("array<string>")
    for d in DIALECTS:
        out = F.when(F.col(source_col) == d, M.mentions(text_col, d)).otherwise(out)
    return out


def _dialect_mentions_sql(x="text", s="source"):
    parts = " ".join(f"WHEN {s} = {S.q(d)} THEN {ST.mentions_list(x, d)}" for d in DIALECTS)
    return f"CASE {parts} ELSE CAST([] AS VARCHAR[]) END"


def _dialect_relevant(text_col="text", source_col="source"):
    out = F.lit(False)
    for d in DIALECTS:
        out = F.when(F.col(source_col) == d, M.relevant(text_col, d)).otherwise(out)
    return out


def _dialect_relevant_sql(x="text", s="source"):
    parts = " ".join(f"WHEN {s} = {S.q(d)} THEN {ST.relevant(x, d)}" for d in DIALECTS)
    return f"CASE {parts} ELSE false END"


@register("A2_fetched_vs_relevant", sql=f"""
SELECT source, symbol, count(*) AS fetched, count(*) FILTER (WHERE rel) AS relevant FROM (
  SELECT source, unnest(CASE WHEN len(m) = 0 THEN [NULL] ELSE m END) AS symbol, rel FROM (
    SELECT source, {_dialect_mentions_sql()} AS m, {_dialect_relevant_sql()} AS rel FROM ({S.content(True)}) c) x) y
GROUP BY source, symbol""")
def a2(spark, sf):
    c = A.content(spark, sf, templated=True)
    x = c.select("source", F.explode_outer(_dialect_mentions()).alias("symbol"),
                 _dialect_relevant().alias("rel"))
    return x.groupBy("source", "symbol").agg(F.count("*").alias("fetched"),
                                             F.count_if("rel").alias("relevant"))


@register("A9_symbol_sets", sql=f"""
SELECT source, array_to_string(list_sort(list_distinct(flatten(list(m)))), ',') AS symbols,
       count(DISTINCT id) AS n_items
FROM (SELECT id, source, {_dialect_mentions_sql()} AS m FROM ({S.content(True)}) c) x GROUP BY source""")
def a9(spark, sf):
    c = A.content(spark, sf, templated=True)
    x = c.select("id", "source", F.explode_outer(_dialect_mentions()).alias("symbol"))
    # collect_set is bounded by the vocabulary size, never by the data
    return x.groupBy("source").agg(arr_str(F.collect_set("symbol")).alias("symbols"),
                                   F.count_distinct("id").alias("n_items"))


@register("X8_content_tags", sql=f"""
SELECT id, lang AS language, source AS platform, 'text' AS content_type FROM ({S.content()}) c""")
def x8(spark, sf):
    c = A.content(spark, sf)
    t = M.content_tags(F.col("source"), lang="lang")
    return c.select("id", t["language"].alias("language"), t["platform"].alias("platform"),
                    t["content_type"].alias("content_type"))


@register("J6_vocab_join", sql=f"""
SELECT DISTINCT id, symbol FROM (
  SELECT id, unnest(regexp_split_to_array(upper(text), {S.q(r'[^\p{L}\p{N}_]+')})) AS symbol FROM ({S.content()}) c) x
WHERE symbol IN ({', '.join(S.q(s) for s in DATA_SYMBOLS)})""")
def j6(spark, sf):
    # large-vocabulary path: explode word runs + size-checked broadcast join
    c = A.content(spark, sf)
    vocab_df = spark.createDataFrame([(s,) for s in DATA_SYMBOLS], "symbol string")
    return M.mention_rows(c, vocab_df)


# lower-case words of at least four letters in the benchmark items
_BENCHMARK_WORDS = S.q(r"[^\p{L}\p{N}]+")


@register("J6_substring_keywords", sql=f"""
WITH words AS (SELECT DISTINCT w FROM (
  SELECT unnest(regexp_split_to_array(lower(text), {_BENCHMARK_WORDS})) AS w FROM benchmark) x WHERE length(w) >= 4)
SELECT w AS keyword, count(*) AS n_docs FROM ({S.content()}) c JOIN words ON contains(lower(c.text), w) GROUP BY w""")
def j6_substring(spark, sf):
    # a vocabulary from the data, as substrings of all texts in one pass
    from ..sources.tables import table
    split = F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1)
    words = (table(spark, sf, "benchmark").select(F.explode(split).alias("keyword"))
             .where(F.length("keyword") >= 4).distinct())
    hits = K.keyword_rows(A.content(spark, sf), words)
    return hits.groupBy(F.col("label").alias("keyword")).agg(F.count("*").alias("n_docs"))


@register("X6_search_symbols_vocabulary", sql=f"""
SELECT id, unnest({ST.search_symbols('text')}) AS symbol FROM ({S.tweets()}) t""")
def x6_vocabulary(spark, sf):
    # the search terms of all symbols as one keyword table
    terms = {s: [t.replace("{S}", s) for t in vocab.SEARCH_TERMS] for s in vocab.CRYPTO_SYMBOLS}
    hits = K.keyword_rows(A.tweets(spark, sf), K.keyword_vocabulary(spark, terms), label_col="label")
    return hits.select("id", F.col("label").alias("symbol"))


@register("F5_min_relevance", sql=f"""
SELECT id, {S.r6(ST.relevance_score('title', 'text', 'url'))} AS relevance FROM ({_ARTICLE_SQL}) a
WHERE {ST.relevance_score('title', 'text', 'url')} >= 0.3""")
def f5(spark, sf):
    from ..functions import validate as V
    a = _article_like(spark, sf).withColumn("relevance", M.news_relevance_score("title", "text", "url"))
    return a.where(V.min_relevance("relevance", 0.3)).select("id", r6("relevance").alias("relevance"))
