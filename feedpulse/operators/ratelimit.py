"""Request-log analyses re-aimed from client-side limiters and breakers
(A12-A14).  All per-key sequence logic works on the even ranges of
``prefix.py`` so neither a hot key nor a burst lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import KEY, PART, in_range, ordered_parts, over_ranges, previous_value


def rate_check(df: DataFrame, key: str = "key", ts: str = "ts", window_seconds: int = 900,
               limit: int = 300, parts: int | None = None) -> DataFrame:
    """``in_window`` = rows of the key with ts in (t - w, t] (current row
    and same-instant rows included); ``throttled`` when it exceeds ``limit``.

    ``in_window = N(<= t) - N(<= t - w)``, two running counts whose frames only grow, so
    a range is read once, like with two pointers.  A range's halo is what earlier ranges
    hold of the last window before its first row, as counts per instant (a
    burst is one row a range); rows of its last instant also count those of that instant in later ranges.
    """
    w_us = window_seconds * 1_000_000
    # rows of one instant are told apart by a number, so that a burst is cut as well
    rows = ordered_parts(df.withColumns({"__us": F.unix_micros(F.col(ts)), "__row": F.monotonically_increasing_id()}),
                         [key], ["__us", "__row"], parts)
    points = rows.groupBy(PART, KEY, "__us").agg(F.count("*").alias("__n"))
    spans = points.groupBy(PART, KEY).agg(F.min("__us").alias("__lo"), F.max("__us").alias("__hi"),
                                          F.min_by("__n", "__us").alias("__first"))
    later = spans.select(KEY, F.col(PART).alias("__to"), F.col("__lo").alias("__from"))
    reached = spans.join(later, KEY).where((F.col(PART) < F.col("__to")) & (F.col("__hi") > F.col("__from") - w_us))
    halo = (points.join(reached.select(PART, KEY, "__to", "__from"), [PART, KEY])
            .where(F.col("__us") > F.col("__from") - w_us)
            .select(F.col("__to").alias(PART), KEY, "__us", "__n"))
    same = spans.select(KEY, F.col(PART).alias("__to"), F.col("__lo").alias("__hi"), F.col("__first").alias("__more"))
    ends = (spans.select(PART, KEY, "__hi").join(same, [KEY, "__hi"]).where(F.col("__to") > F.col(PART))
            .groupBy(PART, KEY, F.col("__hi").alias("__us")).agg(F.sum("__more").alias("__more")))

    seq = rows.withColumn("__n", F.lit(1).cast("long")).unionByName(halo, allowMissingColumns=True)
    order = in_range("__us")
    upto = F.sum("__n").over(order.rangeBetween(Window.unboundedPreceding, 0))
    out_of = F.sum("__n").over(order.rangeBetween(Window.unboundedPreceding, -w_us))
    seq = seq.withColumn("in_window", upto - F.coalesce(out_of, F.lit(0))).where(F.col("__row").isNotNull())
    out = seq.join(ends, [PART, KEY, "__us"], "left")
    out = out.withColumn("in_window", F.col("in_window") + F.coalesce("__more", F.lit(0)))
    return out.withColumn("throttled", F.col("in_window") > limit).select(*df.columns, "in_window", "throttled")


def min_gap_check(df: DataFrame, key: str = "key", ts: str = "ts", tie: str = "event_id",
                  min_interval_seconds: float = 1.0, parts: int | None = None) -> DataFrame:
    """Seconds since the key's previous request; ``too_soon`` below the
    minimum interval (the first request of a key is never too soon)."""
    p = previous_value(df, [key], ts, tie, ts, "__prev_ts", parts)
    gap = (F.unix_micros(F.col(ts)) - F.unix_micros(F.col("__prev_ts"))) / 1e6
    return (p.withColumn("gap_seconds", gap)
             .withColumn("too_soon", F.coalesce(F.col("gap_seconds") < min_interval_seconds, F.lit(False)))
             .drop("__prev_ts"))


def failure_runs(df: DataFrame, key: str = "key", ts: str = "ts", tie: str = "event_id",
                 is_failure: str = "is_failure", threshold: int = 5, recovery_seconds: int = 60,
                 parts: int | None = None) -> DataFrame:
    """Runs of consecutive failures per key; a run of
    at least ``threshold`` failures is an outage that opens at its
    ``threshold``-th failure and may retry ``recovery_seconds`` after its
    last failure (a success closes it).

    A range reduces its rows of a key to segments: an open prefix, closed runs, an open suffix, each
    with its count, ends and first ``threshold`` failures.  A run is named by the successes before it,
    so segments of one run, however many ranges it crosses, have one name and merge.
    """
    fail = F.coalesce(F.col(is_failure), F.lit(False))
    rows = ordered_parts(df, [key], [ts, tie], parts)
    running = in_range(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__fail": fail, "__S": F.sum((~fail).cast("long")).over(running),
                             "__F": F.sum(fail.cast("long")).over(running)})
    before = F.last(F.when(~F.col("__fail"), F.col("__F")), ignorenulls=True).over(running)
    rows = rows.withColumn("__idx", F.col("__F") - F.coalesce(before, F.lit(0)))
    opening = F.when(F.col("__idx") <= threshold, F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie")))
    segments = rows.where("__fail").groupBy(PART, KEY, "__S").agg(
        F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.collect_list(opening).alias("opening"))
    totals = rows.groupBy(PART, KEY).agg(F.sum((~F.col("__fail")).cast("long")).alias("__n"))
    offsets = totals.select(PART, KEY, (F.sum("__n").over(over_ranges()) - F.col("__n")).alias("__off"))
    runs = (segments.join(offsets, [PART, KEY]).groupBy(KEY, (F.col("__off") + F.col("__S")).alias("run_id")).agg(
        F.sum("n").alias("n_failures"), F.min("first").alias("first_failure"), F.max("last").alias("last_failure"),
        F.sort_array(F.flatten(F.collect_list("opening"))).alias("opening")))
    return (runs.where(F.col("n_failures") >= threshold)
            .select(F.col(KEY)[key].alias(key), "run_id", "n_failures", "first_failure", "last_failure",
                    F.col("opening")[threshold - 1]["at"].alias("opened_at"),
                    (F.col("last_failure") + F.make_dt_interval(secs=F.lit(recovery_seconds))).alias("retry_at")))
