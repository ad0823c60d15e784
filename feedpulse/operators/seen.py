"""Ids seen by earlier runs, as a bucketed table (J7, U2 across runs).

``new_only`` joins a run with all seen ids, and shuffles both.  Here the seen ids are stored in buckets by a
hash of the id, so that a run shuffles its own rows only, however many ids have been seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, removed_at_exit

RUN = "run"


class SeenIds:
    """The stored ids: ``(key, run)`` in ``buckets`` buckets, under ``path``; without a path they live in the
    session's shared folder until the application ends.  ``key_type`` is a SQL type.  The number
    of buckets stays; choose it for the ids to come."""

    def __init__(self, spark: SparkSession, name: str, key_type: str, key: str = "id", buckets: int = 200,
                 path: str | None = None):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets
        self.path = path
        if not spark.catalog.tableExists(name):
            # the first write makes the folder, which can then be marked for removal
            self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/seen/{name}-{uuid.uuid4().hex[:12]}"
            self._append(spark.createDataFrame([], f"`{key}` {key_type}, {RUN} string"))
            if path is None:
                removed_at_exit(spark, self.path)
        elif path is None:
            raise ValueError(f"table {name} exists: name its path")

    def _append(self, ids: DataFrame) -> None:
        (ids.write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name))

    def ids(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, rows: DataFrame, run: str) -> DataFrame:
        """The rows whose id no other run has seen.  A run that is repeated after a failure, with its name, gets the
        same rows again.  Rows that repeat an id all stay (``dedup_first`` goes before); a null id is always new."""
        others = self.ids().where(F.col(RUN) != run).select(self.key)
        return rows.join(others, self.key, "left_anti").select(*rows.columns)

    def add(self, rows: DataFrame, run: str) -> None:
        """Store the ids of a run that is done: its files are added, stored ones are not written again."""
        ids = rows.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        # one task a bucket, so a run adds one file to each
        self._append(ids.withColumn(RUN, F.lit(run)).repartition(self.buckets, self.key))
