"""Readers for landed tables and raw records.

Parquet is the default: predicate pushdown and column pruning reach the scan.
Landed raw JSON / XML feeds are read with an explicit schema (never inferred
at scale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str, even: bool = True) -> DataFrame:
    """A driver table.  ``even=False`` leaves a small text table in the splits it was landed in, for
    readers that first filter it."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if even and name in TEXT_TABLES:
        # CPU-heavy text work: make sure a one-split input still uses every core
        from ..operators.parallel import spread
        df = spread(df)
    return df


def read_json(spark: SparkSession, path: str, schema: StructType | str,
              multiline: bool = False) -> DataFrame:
    """Landed JSON records (one per line unless ``multiline``) with a fixed schema."""
    return (spark.read.schema(schema).option("multiLine", multiline)
            .option("mode", "PERMISSIVE").json(path))


def read_feed_xml(spark: SparkSession, path: str, schema: StructType | str | None = None,
                  row_tag: str = "item") -> DataFrame:
    """S5 raw form: landed RSS documents, one row per ``<item>`` (built-in XML reader)."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)
