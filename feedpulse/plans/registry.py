"""Registry of end-to-end queries, keyed by inventory ID.

Each query is a ``(spark, sf_dir) -> DataFrame`` plan over the full driver
tables (or data Spark derives from them) plus, where SQL can express it, an
equivalent DuckDB oracle over the same parquet views.  Output conventions
shared by both sides: doubles rounded to 6 dp, counts as BIGINT, arrays as
sorted comma-joined strings, timestamps as ``YYYY-MM-DD HH:MM:SS`` strings.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


# --- shared output formatting ------------------------------------------------

def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def ts_str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def arr_str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.sort_array(c), ",")
