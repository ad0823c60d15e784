"""A12-A14 (distributed by even ranges) against brute force on a skewed log."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from feedpulse.operators import ratelimit as RL


def make_log(n=4000, seed=3):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 0, 1, 2, 5, 30, 400])          # ties and gaps
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(20)}"
        rows.append((i, key, t * 1_000_000 + rnd.choice([0, 0, 500_000]), rnd.random() < 0.3))
    return rows


def frame(spark, rows):
    return (spark.createDataFrame(rows, "event_id long, key string, us long, is_failure boolean")
            .withColumn("ts", F.timestamp_micros("us")))


def test_rate_check(spark):
    rows = make_log()
    w = 60 * 1_000_000
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r[2])
    want = {r[0]: sum(1 for u in by[r[1]] if r[2] - w < u <= r[2]) for r in rows}
    got = RL.rate_check(frame(spark, rows), window_seconds=60, limit=3, parts=9).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.in_window == want[g.event_id]
        assert g.throttled == (want[g.event_id] > 3)


def test_min_gap(spark):
    rows = make_log()
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        p = last.get(r[1])
        want[r[0]] = None if p is None else (r[2] - p) / 1e6
        last[r[1]] = r[2]
    got = RL.min_gap_check(frame(spark, rows), min_interval_seconds=1.0, parts=9).collect()
    for g in got:
        assert g.gap_seconds == want[g.event_id]
        assert g.too_soon == (want[g.event_id] is not None and want[g.event_id] < 1.0)


def test_failure_runs(spark):
    rows = make_log()
    runs, cur = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if r[3]:
            cur.setdefault(r[1], []).append(r)
        else:
            if len(cur.get(r[1], [])) >= 3:
                runs[r[1]].append(cur[r[1]])
            cur[r[1]] = []
    for k, v in cur.items():
        if len(v) >= 3:
            runs[k].append(v)
    want = sorted((k, len(v), v[2][2]) for k, rs in runs.items() for v in rs)
    got = RL.failure_runs(frame(spark, rows), threshold=3, parts=9) \
        .select("key", "n_failures", F.unix_micros("opened_at").alias("o")).collect()
    assert sorted((g.key, g.n_failures, g.o) for g in got) == want


def test_window_longer_than_ranges_and_bursts(spark):
    """A window that spans many ranges, and an instant that holds a third of the rows."""
    rows = [(i, "hot" if i % 3 else None, 0 if i % 4 == 0 else i * 1_000_000, False) for i in range(1200)]
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r[2])
    for seconds in (1, 40, 700):
        want = {r[0]: sum(1 for u in by[r[1]] if r[2] - seconds * 1_000_000 < u <= r[2]) for r in rows}
        for parts in (1, 16):
            got = RL.rate_check(frame(spark, rows), window_seconds=seconds, parts=parts).collect()
            assert {g.event_id: g.in_window for g in got} == want


def test_one_outage_over_all_ranges(spark):
    """A third of the log is one run of failures; its segments merge."""
    rows = [(i, "hot", i * 1_000_000, 100 <= i < 900) for i in range(1000)] + [(2000 + i, f"k{i % 7}", i * 1_000_000, i % 2 == 0) for i in range(1400)]
    for parts in (1, 32):
        got = RL.failure_runs(frame(spark, rows), parts=parts).select(
            "key", "run_id", "n_failures", *[(F.unix_micros(c) / 1e6).alias(c) for c in ("first_failure", "last_failure", "opened_at", "retry_at")]).collect()
        assert [tuple(g) for g in got] == [("hot", 100, 800, 100.0, 899.0, 104.0, 959.0)]


def test_plan_reads_the_log_once(spark):
    """The result reads the cut table, never the log again."""
    log = frame(spark, make_log(100))
    plan = RL.rate_check(log, parts=4)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "LocalTableScan" not in plan
