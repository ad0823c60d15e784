"""Score ensembles (E1-E9) over long-form score rows.

Score rows: ``id, source, created_at, model, value, confidence, ok``.  One
row per (text, model); a failed model keeps its row with ``ok = false`` and
contributes the fallback (0, 0) (E8) - rows never vanish.

The rolling performance history (E4) is the only order-dependent piece.  A
plain ``Window.partitionBy(source, model)`` would put each (source, model)
stream into a single task, so rows are cut into ranges of (key, time, id):

1. inside a range, running success count and confidence sum, and the sum of the
   last ``n`` successes as a difference of running sums (exact DECIMAL arithmetic);
2. range totals -> cumulative offsets (one row per range and key, small);
3. halo: each range gets the last ``n`` successes of the ranges before it, which its
   first ``n`` rows still reach, as one array of at most ``n`` sums per range and key.

No row is joined with another; ranges are even whatever the keys and times are.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from .prefix import KEY, PART, in_range, ordered_parts, over_ranges

DEC = "decimal(38,18)"


def source_group(source) -> Column:
    s = F.col(source) if isinstance(source, str) else source
    return (F.when(s.isin(vocab.SOCIAL_SOURCES), "social")
            .when(s.isin(vocab.NEWS_SOURCES), "news").otherwise("default"))


def _map_literal(d: Mapping[str, float]) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])


def top_level_weights_map(source, table: Mapping[str, Mapping[str, float]] = vocab.ENSEMBLE_WEIGHTS) -> Column:
    """E5: weight map of the source's group (fixed-size literal, no join)."""
    g = source_group(source)
    return (F.when(g == "social", _map_literal(table["social"]))
            .when(g == "news", _map_literal(table["news"]))
            .otherwise(_map_literal(table["default"])))


def weights_table(spark: SparkSession, table: Mapping[str, Mapping[str, float]] = vocab.ENSEMBLE_WEIGHTS) -> DataFrame:
    """E5 as a ``(source_group, model, weight)`` table for user weight sets."""
    rows = [(g, m, float(w)) for g, ws in table.items() for m, w in ws.items()]
    return spark.createDataFrame(rows, "source_group string, model string, weight double")


def map_model_name(model) -> Column:
    """E6."""
    m = F.col(model) if isinstance(model, str) else model
    out = m
    for k, v in vocab.MODEL_NAME_MAP.items():
        out = F.when(m == k, F.lit(v)).otherwise(out)
    return out


def with_fallback(scores: DataFrame) -> DataFrame:
    """A failed model contributes (0, 0, '<model>_fallback')."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return (scores
            .withColumn("value", F.when(ok, F.col("value")).otherwise(F.lit(0.0)))
            .withColumn("confidence", F.when(ok, F.col("confidence")).otherwise(F.lit(0.0)))
            .withColumn("model_name", F.when(ok, F.col("model"))
                        .otherwise(F.concat(F.col("model"), F.lit("_fallback"))))
            .withColumn("ok", ok))


def performance_factor(scores: DataFrame, partition_by: Sequence[str] = ("source", "model"),
                       order_by: Sequence[str] = ("created_at", "id"), history: int = vocab.HISTORY_SIZE,
                       carried: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``0.5 + mean(confidence of the last <= history successes)``.

    The current row counts when it succeeded; failures never enter the
    history; an empty history gives 1.0.  Adds ``perf`` and ``succ_k``.
    ``carried`` is the history that rows start from (``history_tail`` of earlier rows).
    """
    part = [PART, KEY]
    none = F.lit(0).cast(DEC)
    ok = F.coalesce(F.col("ok"), F.lit(False))
    rows = ordered_parts(scores, partition_by, order_by, parts)
    if carried is not None:
        carried = carried.select(F.struct(*partition_by).alias(KEY), "succ_k", "confidence")
    rows = rows.withColumns({"__ok": ok, "__cd": F.when(ok, F.col("confidence")).otherwise(F.lit(0.0)).cast(DEC)})

    running = in_range(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({"__lk": F.sum(F.col("__ok").cast("long")).over(running), "__ls": F.sum("__cd").over(running)})
    successes = Window.partitionBy(*part, "__ok").orderBy(*order_by)
    before = F.coalesce(F.lag("__ls", history).over(successes), none)
    local = local.withColumn("__recent", F.when(F.col("__ok"), F.col("__ls") - before))
    local = local.withColumn("__recent", F.coalesce(F.last("__recent", ignorenulls=True).over(running), none))

    # successes before each range: one row per range and key
    totals = rows.groupBy(*part).agg(F.sum(F.col("__ok").cast("long")).alias("__n"))
    if carried is not None:
        earlier = carried.groupBy(KEY).agg(F.max("succ_k").alias("__n")).withColumn(PART, F.lit(-1))
        totals = totals.unionByName(earlier)
    offsets = totals.withColumn("__off", F.sum("__n").over(over_ranges()) - F.col("__n")).where(F.col(PART) >= 0)

    # halo: success k of a key reaches the ranges whose offset lies in [k, k + history)
    tails = (local.where("__ok").join(offsets, part)
             .where(F.col("__lk") > F.col("__n") - history)
             .select(KEY, (F.col("__off") + F.col("__lk")).alias("__k"), "__cd"))
    if carried is not None:
        tails = tails.unionByName(carried.select(KEY, F.col("succ_k").alias("__k"), F.col("confidence").cast(DEC).alias("__cd")))
    tails = tails.withColumn("__cell", F.floor(F.col("__k") / history))
    cells = F.array_distinct(F.array(F.floor(F.col("__off") / history), F.floor((F.col("__off") - history + 1) / history)))
    reached = (offsets.where("__off > 0").withColumn("__cell", F.explode(cells)).join(tails, [KEY, "__cell"])
               .where((F.col("__k") <= F.col("__off")) & (F.col("__k") > F.col("__off") - history))
               .groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("__k", "__cd")), asc=False).alias("__last")))
    start = F.struct(none.alias("sum"), F.array(none).alias("sums"))
    # sums of the last 0, 1, 2, ... successes before the range

    def one_more(acc: Column, x: Column) -> Column:
        total = (acc["sum"] + x["__cd"]).cast(DEC)
        return F.struct(total.alias("sum"), F.concat(acc["sums"], F.array(total)).alias("sums"))
    sums = F.aggregate("__last", start, one_more)["sums"]
    halo = offsets.join(reached.select(*part, sums.alias("__halo")), part, "left").select(*part, "__off", "__halo")

    g = local.join(halo, part).withColumn("succ_k", F.col("__lk") + F.col("__off"))
    open_places = F.least(F.lit(history) - F.col("__lk"), F.size("__halo") - 1)
    from_halo = F.when((F.col("__lk") < history) & F.col("__halo").isNotNull(),
                       F.element_at("__halo", (open_places + 1).cast("int"))).otherwise(none)
    total = (F.col("__recent") + from_halo).cast("double")
    perf = F.when(F.col("succ_k") > 0, F.lit(0.5) + total / F.least(F.col("succ_k"), F.lit(history))).otherwise(F.lit(1.0))
    return g.withColumn("perf", perf).select(*scores.columns, "succ_k", "perf")


def history_tail(scored: DataFrame, carried: DataFrame | None = None, partition_by: Sequence[str] = ("source", "model"),
                 history: int = vocab.HISTORY_SIZE) -> DataFrame:
    """The last successes per key, ``(keys, succ_k, confidence)``, at most ``history`` each: what
    ``performance_factor`` needs to go on after the rows of ``scored`` (its output)."""
    rows = scored.where("ok").select(*partition_by, "succ_k", "confidence")
    if carried is not None:
        rows = rows.unionByName(carried)
    newest = rows.groupBy(F.struct(*partition_by).alias(KEY)).agg(F.max("succ_k").alias("__top"))
    return (rows.withColumn(KEY, F.struct(*partition_by)).join(newest, KEY)
            .where(F.col("succ_k") > F.col("__top") - history).drop("__top", KEY))


def performance_factor_window(scores: DataFrame, partition_by: Sequence[str] = ("source", "model"),
                              order_by: Sequence[str] = ("created_at", "id"),
                              history: int = vocab.HISTORY_SIZE) -> DataFrame:
    """E4 reference form (one window per key) - small inputs and tests only."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    w = (Window.partitionBy(*partition_by).orderBy(*order_by)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = scores.withColumn("succ_k", F.sum(ok.cast("long")).over(w))
    w2 = Window.partitionBy(*partition_by).orderBy("succ_k").rangeBetween(-(history - 1), 0)
    avg = F.avg(F.when(ok, F.col("confidence"))).over(w2)
    return s.withColumn("perf", F.when(F.col("succ_k") > 0, F.lit(0.5) + avg).otherwise(F.lit(1.0)))


def adaptive_ensemble(scores: DataFrame, id_cols: Sequence[str] = ("id", "source"),
                      min_confidence: float = vocab.MIN_CONFIDENCE,
                      weights: Mapping[str, Mapping[str, float]] = vocab.ENSEMBLE_WEIGHTS,
                      default_weight: float = vocab.DEFAULT_MODEL_WEIGHT,
                      carry: Sequence[str] = ()) -> DataFrame:
    """E2 over fallback-filled score rows with a ``perf`` column (from E4).

    ``w = base * confidence * perf`` when ``confidence > min_confidence``
    else 0; weights normalised per text; an all-zero text uses equal weights.
    The base weight is looked up by the *raw* model name (D2): "transformer"
    is not a key of the weight table, so it gets the default 0.5.
    """
    base = F.coalesce(F.element_at(top_level_weights_map(F.col("source"), weights), F.col("model")),
                      F.lit(default_weight))
    w = F.when(F.col("confidence") > min_confidence, base * F.col("confidence") * F.col("perf")) \
        .otherwise(F.lit(0.0))
    s = scores.withColumn("__w", w)
    g = s.groupBy(*id_cols).agg(
        F.sum("__w").alias("__tw"),
        F.count("*").alias("__n"),
        F.sum(F.col("value") * F.col("__w")).alias("__vw"),
        F.sum(F.col("confidence") * F.col("__w")).alias("__cw"),
        F.sum("value").alias("__v"),
        F.sum("confidence").alias("__c"),
        *[F.max(c).alias(c) for c in carry],
    )
    pos = F.col("__tw") > 0
    value = F.when(pos, F.col("__vw") / F.col("__tw")).otherwise(F.col("__v") / F.col("__n"))
    conf = F.when(pos, F.col("__cw") / F.col("__tw")).otherwise(F.col("__c") / F.col("__n"))
    return g.select(*id_cols, value.alias("value"), conf.alias("confidence"),
                    F.lit("adaptive_ensemble").alias("model_name"), *carry)


def weighted_ensemble(scores: DataFrame, id_cols: Sequence[str] = ("id", "source"),
                      weights: Mapping[str, Mapping[str, float]] = vocab.ENSEMBLE_WEIGHTS,
                      default_weight: float = vocab.DEFAULT_MODEL_WEIGHT,
                      normalize: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Weights from the source group after E6 name mapping; unnormalised
    by default (D3), ``normalize=True`` divides by the weight sum (W2)."""
    w = F.coalesce(F.element_at(top_level_weights_map(F.col("source"), weights), map_model_name("model")),
                   F.lit(default_weight))
    s = scores.withColumn("__w", w)
    g = s.groupBy(*id_cols).agg(F.sum(F.col("value") * F.col("__w")).alias("value"),
                                F.sum(F.col("confidence") * F.col("__w")).alias("confidence"),
                                F.sum("__w").alias("__tw"), *[F.max(c).alias(c) for c in carry])
    if normalize:
        g = g.withColumn("value", F.col("value") / F.col("__tw")) \
             .withColumn("confidence", F.col("confidence") / F.col("__tw"))
    return g.drop("__tw").withColumn("model_name", F.lit("weighted_ensemble"))


def transformer_ensemble(wide: DataFrame, finbert: str = "finbert", roberta: str = "twitter_roberta",
                         source: str = "source", weighted: bool = True,
                         weights: Mapping[str, Mapping[str, float]] = vocab.TRANSFORMER_WEIGHTS) -> DataFrame:
    """E1 on a wide row with ``<model>_value`` / ``<model>_confidence``
    columns; null in either model gives null (both fail together)."""
    fv, fc = F.col(f"{finbert}_value"), F.col(f"{finbert}_confidence")
    rv, rc = F.col(f"{roberta}_value"), F.col(f"{roberta}_confidence")
    if weighted:
        g = source_group(source)

        def pick(model):
            return (F.when(g == "social", F.lit(weights["social"][model]))
                    .when(g == "news", F.lit(weights["news"][model]))
                    .otherwise(F.lit(weights["default"][model])))
        wf, wr = pick("finbert"), pick("twitter_roberta")
        value, conf = fv * wf + rv * wr, fc * wf + rc * wr
    else:
        value, conf = (fv + rv) / 2, (fc + rc) / 2
    return wide.withColumn("value", value).withColumn("confidence", conf) \
        .withColumn("model_name", F.lit("transformer_ensemble"))


def score_content(content: DataFrame, score_rows: DataFrame, mode: str = "adaptive",
                  text_col: str = "text", partition_by: Sequence[str] = ("source", "model")) -> DataFrame:
    """Ensemble score per content row.

    ``score_rows`` are the long-form per-model rows (e.g. M1 output plus a
    classifier).  Null and blank texts get the
    ``ensemble_error`` marker (0, 0) (D1: validate the text at scoring time); long texts are scored.
    When the score rows carry a ``text_ok`` flag (computed in the scan that
    produced them) it rides through the ensemble aggregate; otherwise the
    content is read again and joined by id.
    """
    from ..functions.validate import has_text
    filled = with_fallback(score_rows)
    carried = "text_ok" in score_rows.columns
    carry = ["text_ok"] if carried else []
    if mode == "adaptive":
        filled = performance_factor(filled, partition_by=partition_by)
        ens = adaptive_ensemble(filled, carry=carry)
    elif mode == "weighted":
        ens = weighted_ensemble(filled, carry=carry)
    else:
        raise ValueError(f"unknown ensemble mode {mode!r}")
    if carried:
        out = ens.withColumnRenamed("text_ok", "__valid")
    else:
        valid = content.select("id", has_text(F.col(text_col)).alias("__valid"))
        out = ens.join(valid, "id")
    err = ~F.coalesce(F.col("__valid"), F.lit(False))
    return out.select(
        "id", "source",
        F.when(err, F.lit(0.0)).otherwise(F.col("value")).alias("value"),
        F.when(err, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(err, F.lit("ensemble_error")).otherwise(F.col("model_name")).alias("model_name"),
    )
