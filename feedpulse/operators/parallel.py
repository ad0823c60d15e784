"""Parallelism guard for CPU-heavy text stages.

A large input already arrives in many file splits; a small one (a file with
a single parquet row group) arrives as one busy partition - Spark may still
report several splits, all but one empty - and would run every regex on one
core.  ``spread`` round-robins only small scans (few partitions, fewer files
than cores), so on a cluster reading terabytes it is a no-op: no extra
shuffle, and no file listing is pulled to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def missing_splits(scan: DataFrame, min_partitions: int | None = None) -> int | None:
    """The number of partitions a small scan should be dealt out to; None where it has enough of its own."""
    target = min_partitions or scan.sparkSession.sparkContext.defaultParallelism
    n = scan.rdd.getNumPartitions()
    return target if n < target or (n <= 4 * target and len(scan.inputFiles()) < target) else None


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    target = missing_splits(df, min_partitions)
    return df.repartition(target) if target else df
