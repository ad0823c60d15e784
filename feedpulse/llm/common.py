"""Shared helpers: written intermediates, name-safe columns, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests, bench) without the setting gets a folder of its
    own; a cluster without it is an error, since executors could not see a
    machine-local folder.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="llm-tables-")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of an action go as soon as its table is written: what follows
    reads the table, so they would only fill the disks."""
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The table survives lost executors; it is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    hadoop_path, fs = _path(spark, path)
    fs.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no later step reads."""
    for table in tables:
        hadoop_path, fs = _path(table.sparkSession, table.written_path)
        fs.delete(hadoop_path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, whatever else ``df`` carries
    (extra columns may clash with names that the operator uses inside)."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, root)`` with the
    smallest reachable node as root, for every node of an edge.

    Alternating large-star / small-star: each round is a grouped minimum and a join
    back, written out so that lineage stays short.  Hot nodes are pre-aggregated by the
    grouped minimum, and the join back is one that adaptive execution can split.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(low, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .filter("a <> b").distinct(), "edges")
    for _ in range(rounds):
        step = written(star(current, large=True), "large")
        after = written(star(step, large=False), "small")
        dropped(current, step)
        current = after
        # settled when the edges are stars: every node has one edge, and no node that an edge leads
        # to has an edge of its own
        if (current.groupBy("a").count().filter("count > 1").isEmpty()
                and current.join(current.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()):
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
