"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully materialised through the ``noop`` sink (no collect),
after one warm-up pass; the median of $BENCH_RUNS runs is reported.  The
scoring pipeline is the lexicon scorer plus a deterministic stub classifier
through the adaptive ensemble - no transformer model is in the loop.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedpulse.plans.catalog import REGISTRY  # noqa: E402
from feedpulse.session import local_session  # noqa: E402

HEADLINE = [
    "E9_score_content",              # lexicon + stub classifier + E4 history + adaptive ensemble
    "M1_sentiment_by_source_label",  # flagship: lexicon job + label + per-group aggregate
    "X1_mentions_by_dialect",        # five mention dialects over all content
    "X2_relevance_by_dialect",
    "N6_normalize_discord",
    "S4_crypto_threads",
    "S6_N1_news_articles",           # HTML extraction (Arrow UDF) + news scoring
    "A1_aggregate_sentiment",
    "A12_rate_check",
    "A14_failure_runs",
    "E4_performance_factor",
]


def run_once(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    REGISTRY[name].build(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cores=cpus)
    timings: dict[str, float] = {}
    for name in names:
        run_once(spark, name, sf)  # warm-up (JIT, codegen, file listing)
        timings[name] = round(statistics.median(run_once(spark, name, sf) for _ in range(runs)), 3)
    n_docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").count()
    e9 = timings.get("E9_score_content")
    out = {
        "metric": "headline_queries_median_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "documents": n_docs,
        "scored_texts_per_sec": round(n_docs / e9, 1) if e9 else None,
        "note": "lexicon + stub classifier through the adaptive ensemble; no transformer model",
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
