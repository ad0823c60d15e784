"""Structured Streaming jobs.

Streams reuse the batch column functions and normalisers unchanged; only
state is stream-specific:

* R4 dedup is a stateful processor on RocksDB with one value per id and a time to
  live.  It has no watermark, so no row is dropped for being late; what arrives
  behind the stream's clock is written to a late part of the output, and
  ``completed`` joins both to one row per id, whatever the batches were;
* R6 carries the last <= 100 successes per (source, model) as a small table from one
  micro-batch to the next, and runs the batch operator E4 on each micro-batch, so
  a key's rows are spread over tasks;
* R8 writes mergeable sums per window and micro-batch; late rows amend windows that
  were written before, and sessions that meet are merged;
* sinks are idempotent: ``foreachBatch`` writes each micro-batch to a folder
  named by its batch id with overwrite, so a retried batch replaces itself.

Checkpoints and outputs live under the session's shared
``spark.checkpoint.dir`` (see ``feedpulse.session``).
"""

from __future__ import annotations

import contextlib
import uuid
from datetime import timedelta
from typing import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .. import vocab
from ..functions import mentions as M
from ..functions import validate as V
from ..operators import fetch as FE
from ..operators import normalize as N
from ..operators.aggregate import DEFAULT_SOURCE_WEIGHTS
from ..operators.aggregate import _weight_of as weight_of
from ..operators.ensemble import history_tail, performance_factor
from ..session import checkpoint_dir

# FIXED VALUES: cadence setting (R7): 60 s interval
POLL_INTERVAL = "60 seconds"


# --- sources ------------------------------------------------------------------------

def read_landed(spark: SparkSession, path: str, schema=None, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed files as a stream (JSON needs an explicit schema)."""
    r = spark.readStream.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    elif fmt == "parquet":
        r = r.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.rstrip("/").endswith("." + fmt) and "*" not in path:
        # a single landed file: glob it so the source lists it from its folder
        path = path.rstrip("/")[:-1] + "[" + path.rstrip("/")[-1] + "]"
    return r.load(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, payload_schema, group_id: str | None = None,
                 starting_offsets: str = "latest", max_offsets_per_trigger: int = 500) -> DataFrame:
    """Message-bus source with the payload parsed by ``from_json``.
    Needs the Kafka connector on the classpath (not bundled here)."""
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic)
         .option("startingOffsets", starting_offsets)
         .option("maxOffsetsPerTrigger", max_offsets_per_trigger))
    if group_id:
        r = r.option("kafka.group.id", group_id)
    return parse_payload(r.load(), payload_schema)


def parse_payload(raw: DataFrame, payload_schema, value_col: str = "value") -> DataFrame:
    """JSON payload column -> typed fields (bus records or landed files)."""
    return raw.select(F.from_json(F.col(value_col).cast("string"), payload_schema).alias("r")).select("r.*")


# --- transformations -----------------------------------------------------------------

class FirstPerKey(StatefulProcessor):
    """Passes the first row of each key (the earliest of its micro-batch) and remembers the key
    for ``keep_ms`` of processing time."""

    def __init__(self, ts: str, keep_ms: int):
        self.ts, self.keep_ms = ts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows, not a pandas frame per key: most keys have one row, and the frame cost more than the state
        first = next(rows, None)
        for row in rows:
            if row[self.ts] is not None and (first[self.ts] is None or row[self.ts] < first[self.ts]):
                first = row
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def dedup(df: DataFrame, key: str = "id", ts: str = "created_at", keep: timedelta = timedelta(hours=24)) -> DataFrame:
    """One row per id among those that arrive within ``keep`` of each other, late rows
    included.  Write it with ``run_deduplicated``."""
    return df.groupBy(key).transformWithState(
        FirstPerKey(ts, int(keep.total_seconds() * 1000)), df.schema, "append", "ProcessingTime")


LATE = "late"


def late_writer(out_path: str, ts: str = "created_at", delay: timedelta = timedelta(hours=1)
                ) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch once, on-time and late rows apart.  A row is late if its event time
    lies more than ``delay`` behind the newest one of earlier micro-batches; these clocks are
    one-row tables beside the output, so a retried or restarted batch decides alike."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, clocks = batch.sparkSession, f"{out_path}_clock"
        clock = None
        if batch_id > 0:
            clock = (spark.read.schema("newest timestamp, batch_id long").parquet(clocks).where(F.col("batch_id") < batch_id)
                     .agg(F.max("newest")).first()[0])
        behind = F.lit(False) if clock is None else F.coalesce(F.col(ts) < F.lit(clock - delay), F.lit(False))
        path = f"{out_path}/batch_id={batch_id}"
        batch.withColumn(LATE, behind).write.mode("overwrite").partitionBy(LATE).parquet(path)
        written = spark.read.schema(batch.schema).parquet(path)
        written.agg(F.max(ts).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{clocks}/batch_id={batch_id}")
    return write


def completed(spark: SparkSession, out_path: str, schema: StructType, key: str = "id") -> DataFrame:
    """What ``late_writer`` wrote, on-time rows completed by late ones: one row per key, of those that
    outlived their key's state the one that came first."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType()), StructField(LATE, BooleanType())])).parquet(out_path)
    return FE.top_n_per_key(rows, [key], [F.col("batch_id")], 1).drop("batch_id")


def run_deduplicated(df: DataFrame, name: str, key: str = "id", ts: str = "created_at",
                     delay: timedelta = timedelta(hours=1)) -> DataFrame:
    """Drain a ``dedup`` stream and read its completed result back, with ``late`` as a column."""
    spark = df.sparkSession
    base = scratch(spark, name)
    run_foreach(df, late_writer(f"{base}/out", ts, delay), f"{base}/_checkpoint")
    return completed(spark, f"{base}/out", df.schema, key)


def tweet_stream(tweets: DataFrame, symbols: Sequence[str] | None = None,
                 terms: Sequence[str] = vocab.TRACK_TERMS, columns: Sequence[str] = ("*",)) -> DataFrame:
    """Tracked tweets (three terms per symbol), normalised, relevant, deduplicated.  ``columns`` are
    what goes through the state operator (all by default; the id and time are needed)."""
    symbols = list(symbols) if symbols else vocab.CRYPTO_SYMBOLS[:5]
    t = tweets.withColumn("__syms", M.search_symbols("text", symbols, terms)).where(F.size("__syms") > 0)
    n = N.normalize_tweets(t.drop("__syms")).where(M.relevant("text", "twitter"))
    return dedup(n.select(*columns))


def telegram_stream(messages: DataFrame, channels: Sequence[str], columns: Sequence[str] = ("*",)) -> DataFrame:
    """R2: messages of the monitored channel list."""
    m = messages.where(F.col("channel").isin(list(channels)))
    n = N.normalize_telegram(m).where(M.relevant("text", "telegram"))
    return dedup(n.select(*columns))


def discord_stream(messages: DataFrame, channels: DataFrame, columns: Sequence[str] = ("*",)) -> DataFrame:
    """Stream-static semi join on monitored channels, bots dropped."""
    m = FE.monitored_messages(messages, channels)
    m = m.where(V.not_bot("author.is_bot"))
    n = N.normalize_discord(m).where(M.relevant("text", "discord"))
    return dedup(n.select(*columns))


# --- R8: windows that late rows amend ------------------------------------------------------

def window_sums(scored: DataFrame, window: str = "1 hour", slide: str | None = None, gap: str | None = None,
                ts: str = "created_at") -> DataFrame:
    """Mergeable state per symbol and event-time window: weighted sum, weight, count.  ``slide``
    makes windows overlap; ``gap`` makes them sessions that end ``gap`` after their last row."""
    s = (scored.withColumn("symbol", F.explode("symbols_mentioned"))
               .withColumn("__w", weight_of(F.col("source"), DEFAULT_SOURCE_WEIGHTS)))
    win = F.session_window(ts, gap) if gap else F.window(ts, window, slide) if slide else F.window(ts, window)
    return s.groupBy(win.alias("window"), "symbol").agg(
        F.sum(F.col("__w") * F.col("confidence") * F.col("value")).alias("weighted"),
        F.sum(F.col("__w") * F.col("confidence")).alias("weight"),
        F.count("*").alias("n_items")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "symbol",
                                              "weighted", "weight", "n_items")


SUMS = "start timestamp, end timestamp, symbol string, weighted double, weight double, n_items long"


def amend_writer(out_path: str, **window) -> Callable[[DataFrame, int], None]:
    """Per micro-batch, the sums that it adds to any window, old ones included (no watermark, so no
    row is too late).  A retried batch replaces its own sums."""
    def write(batch: DataFrame, batch_id: int) -> None:
        window_sums(batch, **window).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return write


def merged_windows(sums: DataFrame, sessions: bool = False) -> DataFrame:
    """All that was added to a window, in one row.  Sessions of one symbol that overlap are one
    session, also where a late row closes the gap between two that were written before."""
    if sessions:
        ordered = Window.partitionBy("symbol").orderBy("start", "end")
        reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("__new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
        sums = sums.withColumn("__session", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        bounds = ["symbol", "__session"]
        span = [F.min("start").alias("start"), F.max("end").alias("end")]
    else:
        bounds, span = ["start", "end", "symbol"], []
    added = [F.sum(c).alias(c) for c in ("weighted", "weight", "n_items")]
    return sums.groupBy(*bounds).agg(*span, *added).select("start", "end", "symbol", "weighted", "weight", "n_items")


def compact_windows(spark: SparkSession, out_path: str, compacted: str, upto: int, sessions: bool = False) -> None:
    """Merge the sums of micro-batches up to ``upto`` into one table, so that readers of a long stream
    read that and the batches after it."""
    log = spark.read.schema(f"{SUMS}, batch_id long").parquet(out_path).where(F.col("batch_id") <= upto)
    merged_windows(log, sessions).write.mode("overwrite").parquet(compacted)


def windowed_sentiment(sums: DataFrame, sessions: bool = False) -> DataFrame:
    """The A1 weighted sentiment of each symbol and window."""
    value = F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight")).otherwise(F.lit(0.0))
    return merged_windows(sums, sessions).select("start", "end", "symbol", value.alias("sentiment"), "n_items")


def run_windowed(scored: DataFrame, name: str, **window) -> DataFrame:
    """Drain a stream of scores into amendable windows and read them back."""
    spark = scored.sparkSession
    base = scratch(spark, name)
    run_foreach(scored, amend_writer(f"{base}/out", **window), f"{base}/_checkpoint")
    return windowed_sentiment(spark.read.schema(SUMS).parquet(f"{base}/out"), sessions="gap" in window)


# --- R6: rolling model history across micro-batches ------------------------------------------

def history_writer(out_path: str, history: int = vocab.HISTORY_SIZE, keys: Sequence[str] = ("source", "model")
                   ) -> Callable[[DataFrame, int], None]:
    """``0.5 + mean(last <= history successful confidences)`` per key.

    Each micro-batch goes through the distributed batch operator (E4), which starts from the
    successes that earlier micro-batches left: at most ``history`` rows a key, kept
    as a table per batch beside the output.  No task holds a key's rows; a retried batch
    starts from the same history and replaces its own rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, tails = batch.sparkSession, f"{out_path}_history"
        kinds = ", ".join(f"{k} {batch.schema[k].dataType.simpleString()}" for k in keys)
        schema = f"{kinds}, succ_k long, confidence double"
        before = spark.read.schema(schema).parquet(f"{tails}/{batch_id - 1}") if batch_id > 0 else None
        path = f"{out_path}/batch_id={batch_id}"
        scored = performance_factor(batch, keys, history=history, carried=before)
        scored.write.mode("overwrite").parquet(path)
        after = history_tail(spark.read.schema(scored.schema).parquet(path), before, keys, history)
        after.write.mode("overwrite").parquet(f"{tails}/{batch_id}")
    return write


def run_performance_factor(scores: DataFrame, name: str) -> DataFrame:
    """Drain a stream of score rows through R6 and read the result back."""
    spark = scores.sparkSession
    base = scratch(spark, name)
    run_foreach(scores, history_writer(f"{base}/out"), f"{base}/_checkpoint")
    return spark.read.parquet(f"{base}/out").drop("batch_id")


# --- sinks and runners ------------------------------------------------------------------------

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def trigger_kwargs(available_now: bool = False, interval: str = POLL_INTERVAL) -> dict:
    """Production cadence, or drain-and-stop for tests and backfills."""
    return {"availableNow": True} if available_now else {"processingTime": interval}


def batch_writer(out_path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
                 ) -> Callable[[DataFrame, int], None]:
    """Idempotent micro-batch writer (one folder per batch id)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite").format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(f"{out_path}/batch_id={batch_id}")
    return write


def validated_writer(good_path: str, reject_path: str, predicate: Callable[[DataFrame], Column]
                     ) -> Callable[[DataFrame, int], None]:
    """Per micro-batch, good rows to one table and rejects to another."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ok = predicate(batch)
        good, bad = V.split_valid(batch, ok)
        good.write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
    return write


# FIXED VALUES: settings of the state store that the stateful processors need
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              # state with a time to live would ask for empty batches without end
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextlib.contextmanager
def state_settings(spark: SparkSession):
    """A query takes the session's settings when it starts; afterwards these are as before."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_foreach(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                output_mode: str = "append", available_now: bool = True):
    """Run a stream.  With ``available_now`` this waits, however long it takes, until all landed
    data is written, and raises what stopped the stream; otherwise the running query is
    returned to the caller."""
    with state_settings(df.sparkSession):
        q = (df.writeStream.foreachBatch(handler).outputMode(output_mode)
               .option("checkpointLocation", checkpoint).trigger(**trigger_kwargs(available_now)).start())
    if not available_now:
        return q
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append",
                   partition_by: Sequence[str] = ()) -> str:
    """Drain a stream (availableNow) into parquet under the shared folder;
    returns the output path (read it back as a batch table)."""
    spark = df.sparkSession
    base = scratch(spark, name)
    run_foreach(df, batch_writer(f"{base}/out", partition_by=partition_by), f"{base}/_checkpoint",
                output_mode=output_mode)
    return f"{base}/out"


def persist_content(df: DataFrame, path: str, batch_id: int | str, ts_col: str = "created_at") -> None:
    """Content table partitioned by source, day and batch.  A batch written again (a retry)
    replaces its own partitions and no others.  Rows are sorted, not dealt out, by partition: a task
    has one file open at a time, and a day with most rows is written by all tasks that hold it."""
    (df.withColumn("dt", F.to_date(ts_col)).withColumn("batch_id", F.lit(str(batch_id)))
       .sortWithinPartitions("source", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("source", "dt", "batch_id").parquet(path))
