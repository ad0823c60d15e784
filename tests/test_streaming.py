"""R4 / R6 / R8 streaming jobs agree with their batch counterparts."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_dedup_stream(spark):
    from feedpulse.plans.q_streams import r4
    ids = [r.id for r in r4(spark, SF_SMALL).collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_stream_history_equals_batch(spark):
    from feedpulse.operators import ensemble as E
    from feedpulse.plans.q_streams import r6_stream
    from feedpulse.sources import adapters as A
    got = {(r.id, r.model): r.perf for r in r6_stream(spark, SF_SMALL).collect()}
    batch = E.performance_factor(E.with_fallback(A.stub_classifier_scores(A.content(spark, SF_SMALL))))
    want = {(r.id, r.model): r.perf for r in batch.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert abs(got[k] - v) <= 1e-6, k


def test_validated_sink_accounts_every_row(spark):
    from feedpulse.plans.q_streams import r5
    out = r5(spark, SF_SMALL)
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert out.where(~F.col("accepted")).count() > 0


def test_bounded_micro_batches(spark):
    from feedpulse.plans.q_streams import r7_batches
    out = r7_batches(spark, SF_SMALL, files=4)
    assert out.select("batch_id").distinct().count() == 4
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def _landed(spark, folder, files):
    """One file per list of rows, landed in that order."""
    import os
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "id long, created_at timestamp, symbol string").coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):  # the file source goes by modification time
            path = f"{folder}/{f}"
            if f.startswith("part-") and os.path.getmtime(path) > 1_600_000_000:
                os.utime(path, (1_500_000_000 + i, 1_500_000_000 + i))


def _at(hour, second):
    from datetime import datetime, timedelta
    return datetime(2024, 1, 1) + timedelta(hours=hour, seconds=second)


def test_no_row_is_lost_whatever_the_batches(spark, tmp_path):
    """Three files of 100 ids each at hours 10, 0 and 5, some ids landed twice: 300 rows either way."""
    from feedpulse.streaming import streams as ST
    files = [[(100 * i + k, _at(h, k), "x") for k in range(100)] for i, h in enumerate((10, 0, 5))]
    files[1] += files[0][:30] + files[1][:5]
    files[2] += files[1][:40]
    folder = str(tmp_path / "landed")
    _landed(spark, folder, files)
    seen = {}
    for per_batch in (1, 3):
        stream = ST.read_landed(spark, folder, schema="id long, created_at timestamp, symbol string", max_files_per_trigger=per_batch)
        out = ST.run_deduplicated(ST.dedup(stream), "late").collect()
        assert sorted(r.id for r in out) == list(range(300))
        seen[per_batch] = {r.id for r in out if r.late}
    assert seen == {1: set(range(100, 300)), 3: set()}  # hours 0 and 5 come after hour 10


def test_late_duplicates_that_outlived_their_state(spark, tmp_path):
    from datetime import timedelta
    from feedpulse.streaming import streams as ST
    folder = str(tmp_path / "landed")
    _landed(spark, folder, [[(1, _at(9, 0), "a")], [(1, _at(9, 0), "a"), (2, _at(9, 1), "b")]])
    stream = ST.read_landed(spark, folder, schema="id long, created_at timestamp, symbol string", max_files_per_trigger=1)
    out = ST.run_deduplicated(ST.dedup(stream, keep=timedelta(milliseconds=1)), "ttl").collect()
    assert sorted(r.id for r in out) == [1, 2]


def _scores(spark, folder, per_batch):
    from feedpulse.streaming import streams as ST
    s = ST.read_landed(spark, folder, schema="id long, created_at timestamp, symbol string", max_files_per_trigger=per_batch)
    return s.select("id", F.lit("twitter").alias("source"), "created_at", F.array("symbol").alias("symbols_mentioned"),
                    (F.col("id") % 7 / 10).alias("value"), (F.col("id") % 5 / 10 + 0.1).alias("confidence"))


def test_windows_are_amended_whatever_the_batches(spark, tmp_path):
    from feedpulse.streaming import streams as ST
    files = [[(100 * i + k, _at(h, 97 * k), "ab"[k % 2]) for k in range(100)] for i, h in enumerate((10, 0, 2, 1))]
    folder = str(tmp_path / "landed")
    _landed(spark, folder, files)
    batch = spark.createDataFrame(sum(files, []), "id long, created_at timestamp, symbol string")
    batch = batch.select("id", F.lit("twitter").alias("source"), "created_at", F.array("symbol").alias("symbols_mentioned"),
                         (F.col("id") % 7 / 10).alias("value"), (F.col("id") % 5 / 10 + 0.1).alias("confidence"))

    def rows(df):
        return sorted((r.start, r.end, r.symbol, round(r.sentiment, 9), r.n_items) for r in df.collect())
    for window in ({"window": "1 hour"}, {"window": "1 hour", "slide": "30 minutes"}, {"gap": "10 minutes"}):
        want = rows(ST.windowed_sentiment(ST.window_sums(batch, **window)))
        for per_batch in (1, 4):
            assert rows(ST.run_windowed(_scores(spark, folder, per_batch), "r8", **window)) == want, (window, per_batch)
    assert len(want) == 4  # the files at hours 0 to 2 meet in one session a symbol


def test_compacted_windows_go_on(spark, tmp_path):
    from feedpulse.streaming import streams as ST
    files = [[(10 * i + k, _at(h, 60 * k), "a") for k in range(10)] for i, h in enumerate((5, 0, 5))]
    folder = str(tmp_path / "landed")
    _landed(spark, folder, files)
    out, base = str(tmp_path / "out"), str(tmp_path / "merged")
    ST.run_foreach(_scores(spark, folder, 1), ST.amend_writer(out, window="1 hour"), str(tmp_path / "c"))
    ST.compact_windows(spark, out, base, upto=1)
    log = spark.read.schema(f"{ST.SUMS}, batch_id long").parquet(out)
    rest = spark.read.parquet(base).unionByName(log.where("batch_id > 1").drop("batch_id"))
    assert sorted(map(tuple, ST.windowed_sentiment(rest).collect())) == sorted(map(tuple, ST.windowed_sentiment(log.drop("batch_id")).collect()))


def test_stream_history_in_batches(spark, tmp_path):
    """The same scores in one file and in five, one a batch, equal E4."""
    from feedpulse.operators import ensemble as E
    from feedpulse.streaming import streams as ST
    rows = [(k, _at(0, k), "s") for k in range(1000)]

    def scores(df):
        return df.select("id", (F.col("id") % 10 == 0).cast("string").alias("source"), F.lit("m").alias("model"), "created_at",
                         (F.col("id") % 100 / 100).alias("confidence"), (F.col("id") % 3 > 0).alias("ok"))
    schema = "id long, created_at timestamp, symbol string"
    want = {r.id: (r.succ_k, r.perf) for r in E.performance_factor(scores(spark.createDataFrame(rows, schema))).collect()}
    for n in (1, 5):
        folder = str(tmp_path / f"landed{n}")
        _landed(spark, folder, [rows[i * 1000 // n:(i + 1) * 1000 // n] for i in range(n)])
        stream = ST.read_landed(spark, folder, schema=schema, max_files_per_trigger=1)
        got = {r.id: (r.succ_k, r.perf) for r in ST.run_performance_factor(scores(stream), "r6").collect()}
        assert got == want


def test_first_row_of_a_key_without_a_frame_per_key():
    from types import SimpleNamespace

    from feedpulse.streaming import streams as ST
    from pyspark.sql import Row
    seen = []
    first = ST.FirstPerKey("created_at", 1000)
    first.seen = SimpleNamespace(exists=lambda: bool(seen), update=seen.append)
    rows = [Row(id=1, created_at=t, n=n) for n, t in enumerate([None, _at(5, 0), _at(2, 0), _at(2, 0)])]
    assert [r.n for r in first.handleInputRows((1,), iter(rows), None)] == [2]
    assert list(first.handleInputRows((1,), iter(rows), None)) == [] and seen == [(True,)]
    seen.clear()
    assert [r.n for r in first.handleInputRows((1,), iter(rows[:1]), None)] == [0]
