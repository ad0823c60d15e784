"""Registered queries: Structured Streaming jobs drained with ``availableNow``
into parquet under the shared checkpoint folder and read back (R1-R6, R8,
S14).  Their final results don't depend on how the input came in batches, so most
have a SQL oracle equal to the batch semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import validate as V
from ..sources import adapters as A
from ..streaming import streams as ST
from . import q_sources as QS
from . import sql_adapters as S
from . import sql_models as SM
from . import sql_text as SX
from .registry import r6, register, ts_str


def _docs_stream(spark, sf):
    return ST.read_landed(spark, f"{sf.rstrip('/')}/documents.parquet")


def _content_stream(spark, sf, templated=True):
    return A.content_from(_docs_stream(spark, sf), templated)


@register("R1_tweet_stream", sql=f"""
SELECT DISTINCT id FROM (SELECT CAST(id AS VARCHAR) AS id, {S.sanitize('text')} AS clean
  FROM ({S.tweets()}) t WHERE len({SX.search_symbols('text', vocab.CRYPTO_SYMBOLS[:5], vocab.TRACK_TERMS)}) > 0
  AND text <> '') x WHERE length(clean) >= 10 AND {SX.relevant('clean', 'twitter')}""")
def r1_stream(spark, sf):
    s = ST.tweet_stream(A.tweets_from(_content_stream(spark, sf)), columns=["id", "text", "created_at"])
    return ST.run_deduplicated(s, "r1").select("id")


@register("R2_telegram_stream", sql=f"""
SELECT DISTINCT id FROM ({QS.telegram_norm_sql()}) n WHERE channel IN ('@ch1', '@ch2')
  AND {SX.relevant('clean', 'telegram')}""")
def r2(spark, sf):
    s = ST.telegram_stream(A.telegram_from(_content_stream(spark, sf)), ["@ch1", "@ch2"], columns=["id", "created_at"])
    return ST.run_deduplicated(s, "r2").select("id")


@register("R3_discord_stream", sql=f"""
SELECT DISTINCT n.id FROM ({QS.discord_norm_sql()}) n
JOIN ({S.discord_messages()}) d ON d.message_id = n.message_id
WHERE NOT coalesce(d.author_is_bot, false) AND ({QS._monitored_sql().replace('channel_name', 'd.channel_name')})
  AND {SX.relevant('n.clean', 'discord')}""")
def r3(spark, sf):
    static = A.discord_messages(spark, sf).select("channel_id", "channel_name").distinct()
    s = ST.discord_stream(A.discord_from(_content_stream(spark, sf)), static, columns=["id", "created_at"])
    return ST.run_deduplicated(s, "r3").select("id")


@register("R4_dedup_stream", sql="SELECT doc_id AS id FROM documents")
def r4(spark, sf):
    """Every record lands twice, in three files that are read one a batch: most rows of the later
    files are far behind the newest of the first."""
    landed = f"{ST.scratch(spark, 'r4')}/landed"
    c = A.content(spark, sf).select("id", "created_at")
    c.unionByName(c).repartition(3).write.parquet(landed)
    stream = ST.read_landed(spark, landed, schema="id long, created_at timestamp", max_files_per_trigger=1)
    return ST.run_deduplicated(ST.dedup(stream), "r4").select("id")


@register("R5_validated_sink", sql=f"""
SELECT id, coalesce(length({S.strip_ws('text')}) BETWEEN 1 AND 10000, false) AS accepted FROM ({S.content()}) c""")
def r5(spark, sf):
    c = _content_stream(spark, sf, templated=False).select("id", "text")
    base = ST.scratch(spark, "r5")
    handler = ST.validated_writer(f"{base}/good", f"{base}/reject", lambda b: V.text_valid("text"))
    ST.run_foreach(c, handler, f"{base}/_checkpoint")
    good = spark.read.parquet(f"{base}/good").select("id", F.lit(True).alias("accepted"))
    bad = spark.read.parquet(f"{base}/reject").select("id", F.lit(False).alias("accepted"))
    return good.unionByName(bad)


@register("R6_stream_performance", sql=f"""
SELECT id, model, succ_k, round(perf, 9) AS perf FROM ({SM.with_perf(S.stub_scores(S.content()))}) p""")
def r6_stream(spark, sf):
    scores = A.stub_classifier_scores(_content_stream(spark, sf, templated=False))
    return ST.run_performance_factor(scores, "r6").select("id", "model", "succ_k", r6_col())


def r6_col():
    return F.round("perf", 9).alias("perf")


def _r8_sql():
    from ..functions import mentions as M
    from ..operators.aggregate import DEFAULT_SOURCE_WEIGHTS as W
    men = " ".join(f"WHEN source = {S.q(d)} THEN {SX.mentions_list('text', d)}" for d in M.DIALECTS)
    tot = sum(W.values())
    w = "CASE " + " ".join(f"WHEN source = {S.q(k)} THEN {v / tot!r}" for k, v in W.items()) + " ELSE 0.0 END"
    return f"""
WITH c AS (SELECT *, CASE {men} ELSE CAST([] AS VARCHAR[]) END AS syms FROM ({S.content(True)}) c0),
s AS (SELECT c.id, c.source, c.created_at, st.value, st.confidence, c.syms
      FROM c JOIN ({S.stub_scores(S.content(True))}) st ON st.id = c.id),
x AS (SELECT *, unnest(syms) AS symbol, {w} AS w FROM s)
SELECT strftime(time_bucket(INTERVAL 1 HOUR, created_at), '%Y-%m-%d %H:%M:%S') AS window_start, symbol,
  round(CASE WHEN sum(w * confidence) > 0 THEN sum(w * confidence * value) / sum(w * confidence) ELSE 0.0 END, 6) AS sentiment,
  count(*) AS n_items
FROM x GROUP BY 1, 2"""


def _stub_cols():
    i = F.col("id")
    return [(((i * 7) % 201 - 100) / 100.0).alias("value"), (((i * 13) % 101) / 100.0).alias("confidence")]


@register("R8_windowed_sentiment", sql=_r8_sql())
def r8(spark, sf):
    from ..functions import mentions as M
    c = _content_stream(spark, sf)
    men = F.array().cast("array<string>")
    for d in M.DIALECTS:
        men = F.when(F.col("source") == d, M.mentions("text", d)).otherwise(men)
    # stub classifier columns (FIXTURES 1.7) computed in the same projection
    scored = c.select("id", "source", "created_at", men.alias("symbols_mentioned"), *_stub_cols())
    out = ST.run_windowed(scored, "r8", window="1 hour")
    return out.select(ts_str("start").alias("window_start"), "symbol", r6("sentiment").alias("sentiment"), "n_items")


@register("S14_persist_content", sql=f"""
SELECT source, strftime(created_at, '%Y-%m-%d') AS dt, count(*) AS n FROM ({S.content()}) c GROUP BY 1, 2""")
def s14(spark, sf):
    base = ST.scratch(spark, "s14")
    ST.persist_content(A.content(spark, sf), base, batch_id=0)
    ST.persist_content(A.content(spark, sf), base, batch_id=0)  # a retried batch replaces itself
    back = spark.read.parquet(base)  # partition discovery: source, dt
    return back.groupBy("source", F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("n"))


@register("S13_bus_payload", sql=f"""
SELECT id, source, {S.fmt_ts('created_at')} AS created_at FROM ({S.content()}) c""")
def s13(spark, sf):
    # message-bus records carry a JSON payload; the connector jar is not
    # bundled, so the same payload is landed as files and parsed identically
    c = A.content(spark, sf).select("id", "source", "created_at")
    base = ST.scratch(spark, "s13")
    c.select(F.to_json(F.struct("id", "source", "created_at")).alias("value")) \
        .write.mode("overwrite").parquet(f"{base}/landed")
    raw = ST.read_landed(spark, f"{base}/landed", schema="value string")
    parsed = ST.parse_payload(raw, "id long, source string, created_at timestamp")
    out = ST.run_to_parquet(parsed, "s13")
    return spark.read.parquet(out).select("id", "source", ts_str("created_at").alias("created_at"))


def r7_batches(spark, sf, files: int = 4) -> DataFrame:
    """Landed files consumed at most one per trigger; rows tagged with
    the micro-batch that wrote them."""
    base = ST.scratch(spark, "r7")
    spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select("doc_id") \
        .repartition(files).write.mode("overwrite").parquet(f"{base}/landed")
    s = ST.read_landed(spark, f"{base}/landed", schema="doc_id long", max_files_per_trigger=1)
    ST.run_foreach(s, ST.batch_writer(f"{base}/out"), f"{base}/_checkpoint")
    return spark.read.parquet(f"{base}/out")


@register("R7_bounded_micro_batches", sql="SELECT doc_id AS id FROM documents")
def r7(spark, sf):
    return r7_batches(spark, sf).select(F.col("doc_id").alias("id"))
