"""Aggregations and statistics.

All are hash aggregates with map-side partial aggregation (sum / count /
min / max), so a hot group never moves its rows: each task ships one partial
row per group.  Distinct counts shuffle on (group, value), which spreads a
hot group across tasks.  Percentiles use the bounded approximate sketch;
exact percentiles would hold a whole group in memory.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from .prefix import KEY, PART, in_range, ordered_parts, over_ranges

# FIXED VALUES: default request-duration histogram bounds (seconds)
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# Source weights for the multi-source aggregate (ours: the documented
# example has no formula); normalised with W2 before use.
DEFAULT_SOURCE_WEIGHTS = {"twitter": 0.25, "reddit": 0.2, "news": 0.3, "telegram": 0.15, "discord": 0.1}


def _weight_of(source: Column, weights: Mapping[str, float]) -> Column:
    total = sum(weights.values())
    norm = {k: (v / total if total else 1.0 / len(weights)) for k, v in weights.items()}
    out = F.lit(0.0)
    for k, v in norm.items():
        out = F.when(source == k, F.lit(v)).otherwise(out)
    return out


def aggregate_sentiment(scored: DataFrame, keys: Sequence[str] = ("symbol",),
                        weights: Mapping[str, float] = DEFAULT_SOURCE_WEIGHTS,
                        symbols_col: str | None = "symbols_mentioned", window: str | None = None,
                        ts_col: str = "created_at") -> DataFrame:
    """A1: per key (and optional event-time window) weighted sentiment
    ``sum(w*conf*value) / sum(w*conf)``; ``confidence = sum(w*conf)/sum(w)``."""
    df = scored
    if symbols_col:
        df = df.withColumn("symbol", F.explode(symbols_col))
    df = df.withColumn("__w", _weight_of(F.col("source"), weights))
    group = list(keys)
    if window:
        df = df.withColumn("window", F.window(ts_col, window))
        group = ["window", *group]
    g = df.groupBy(*group).agg(
        F.sum(F.col("__w") * F.col("confidence") * F.col("value")).alias("__wcv"),
        F.sum(F.col("__w") * F.col("confidence")).alias("__wc"),
        F.sum("__w").alias("__ws"),
        F.count("*").alias("n_items"),
    )
    sent = F.when(F.col("__wc") > 0, F.col("__wcv") / F.col("__wc")).otherwise(F.lit(0.0))
    conf = F.when(F.col("__ws") > 0, F.col("__wc") / F.col("__ws")).otherwise(F.lit(0.0))
    return g.select(*group, sent.alias("sentiment"), conf.alias("confidence"), "n_items")


def source_stats(content: DataFrame, channel_col: str | None = None, domain_col: str | None = None,
                 feed_col: str | None = None, error_col: str | None = None, ts_col: str = "created_at") -> DataFrame:
    """A3: items, distinct ids (the seen-id count), distinct channels / domains / feeds, and the last error
    (by time, then id; null for a source without errors)."""
    aggs = [F.count("*").alias("items"), F.count_distinct("id").alias("seen_ids")]
    for name, col in [("channels", channel_col), ("domains", domain_col), ("feeds", feed_col)]:
        if col:
            aggs.append(F.count_distinct(col).alias(name))
    if error_col:
        failed = F.when(F.col(error_col).isNotNull(), F.struct(ts_col, "id", error_col))
        aggs.append(F.max(failed)[error_col].alias("last_error"))
    return content.groupBy("source").agg(*aggs)


def model_stats(scores: DataFrame, model_col: str = "model", time_col: str | None = None,
                history: int = vocab.HISTORY_SIZE, lexicon_sizes: Mapping[str, int] | None = None) -> DataFrame:
    """A4: predictions, failures (fallback rows), mean inference time guarded
    by ``max(n, 1)`` (rows without a time count as 0), rolling-history length ``min(successes, history)``,
    and the number of lexicon entries of the models in ``lexicon_sizes`` (null for others)."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    aggs = [F.count("*").alias("predictions"),
            F.count_if(~ok).alias("failures"),
            F.least(F.count_if(ok), F.lit(history)).alias("history_length")]
    if time_col:
        aggs.append((F.coalesce(F.sum(time_col), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_inference_ms"))
    out = scores.groupBy(model_col).agg(*aggs)
    if lexicon_sizes is not None:
        size = F.lit(None).cast("long")
        for model, n in lexicon_sizes.items():
            size = F.when(F.col(model_col) == model, F.lit(n).cast("long")).otherwise(size)
        out = out.withColumn("lexicon_size", size)
    return out


def stats_report(*frames: tuple[str, DataFrame, str]) -> DataFrame:
    """A5: long-form ``(entity, name, metric, value)`` from stats frames given
    as ``(entity, frame, name_column)``."""
    out = None
    for entity, df, name_col in frames:
        metrics = [c for c in df.columns if c != name_col]
        stacked = df.select(F.lit(entity).alias("entity"), F.col(name_col).cast("string").alias("name"),
                            F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                         F.col(m).cast("double").alias("value"))
                                                for m in metrics])).alias("kv"))
        stacked = stacked.select("entity", "name", "kv.metric", "kv.value")
        out = stacked if out is None else out.unionByName(stacked)
    return out


def request_counts(log: DataFrame) -> DataFrame:
    """Requests by method x endpoint x status."""
    return log.groupBy("method", "endpoint", "status").agg(F.count("*").alias("requests"))


def prediction_counts(scores: DataFrame, model_col: str = "model") -> DataFrame:
    """Predictions by model x source."""
    return scores.groupBy(model_col, "source").agg(F.count("*").alias("predictions"))


def duration_histogram(log: DataFrame, keys: Sequence[str] = ("method", "endpoint"),
                       duration_col: str = "duration_ms", bounds: Sequence[float] = DEFAULT_BUCKETS,
                       scale: float = 1 / 1000) -> DataFrame:
    """Cumulative bucket counts (``le``) per key plus ``+Inf``; one
    aggregate with a conditional count per bound, stacked afterwards."""
    d = F.col(duration_col) * scale
    aggs = [F.count_if(d <= b).alias(f"__le{i}") for i, b in enumerate(bounds)]
    g = log.groupBy(*keys).agg(*aggs, F.count("*").alias("__inf"), F.sum(d).alias("sum_seconds"))
    items = [F.struct(F.lit(str(b)).alias("le"), F.col(f"__le{i}").alias("count")) for i, b in enumerate(bounds)]
    items.append(F.struct(F.lit("+Inf").alias("le"), F.col("__inf").alias("count")))
    return g.select(*keys, "sum_seconds", F.explode(F.array(*items)).alias("b")) \
        .select(*keys, "b.le", "b.count", "sum_seconds")


def event_metrics(events: DataFrame, keys: Sequence[str] = ("event_type",),
                  value_col: str = "duration_ms") -> DataFrame:
    """A10: per event type count / mean / min / max of the processing time."""
    v = F.col(value_col)
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.avg(v).alias("avg_ms"),
                                     F.min(v).alias("min_ms"), F.max(v).alias("max_ms"))


#: Reported percentiles and their shares.
PERCENTILES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def event_percentiles(events: DataFrame, keys: Sequence[str] = ("event_type",), value_col: str = "duration_ms",
                      shares: Mapping[str, float] = PERCENTILES, parts: int | None = None) -> DataFrame:
    """A10: exact percentiles (the smallest value whose rank reaches the share); null values don't count, and
    a key without values has no row.

    Selection by ranges: rows are counted per (key, value), map-side combined, and cut into even ranges
    of (key, value).  One row per range and key tells which range holds a rank; only
    those ranges, one per key and share at most, are counted through.  So no task reads all values of a hot key.
    """
    counted = events.where(F.col(value_col).isNotNull()).groupBy(*keys, value_col).agg(F.count("*").alias("__c"))
    rows = ordered_parts(counted, keys, [value_col], parts)
    sizes = rows.groupBy(PART, KEY).agg(F.sum("__c").alias("__in"))
    before = F.coalesce(F.sum("__in").over(over_ranges().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(PART, KEY, "__in", before.alias("__before"),
                         F.sum("__in").over(Window.partitionBy(KEY)).alias("__n"))

    def rank_here(share: float) -> Column:
        rank = F.greatest(F.ceil(F.lit(share) * F.col("__n")), F.lit(1)) - F.col("__before")
        return F.when(rank.between(1, F.col("__in")), rank)
    wanted = sizes.select(PART, KEY, *[rank_here(p).alias(f"__rank_{name}") for name, p in shares.items()])
    wanted = wanted.where(F.coalesce(*[F.col(f"__rank_{name}") for name in shares]).isNotNull())
    found = rows.join(wanted, [PART, KEY]).withColumn(
        "__upto", F.sum("__c").over(in_range(value_col).rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") >= F.col(f"__rank_{name}"), F.col(value_col))).alias(name)
                                      for name in shares])
