"""Session helpers.

Library code never creates sessions; tests, the bench and the examples use
``local_session``.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from
the session (the shared folder a cluster names) and only invents a scratch
folder when the setting is absent, i.e. in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str | int | None = None, shuffle_partitions: int | None = None,
                  app: str = "feedpulse") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    parts = shuffle_partitions or (int(cores) * 2 if str(cores).isdigit() else 16)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FEEDPULSE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder from the session.  Only a local session without the setting (tests,
    bench) gets a scratch folder; on a cluster a missing setting is an error."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="feedpulse-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the application ends."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written_table(df, name: str):
    """Cut lineage: ``df`` written once under the session's shared folder and read back.  The table
    outlives lost executors and is removed when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(removed_at_exit(spark, path))
