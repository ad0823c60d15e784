"""Size-checked broadcast.

A side is broadcast only when its row count is proven to be at most
``max_rows``; otherwise the join is left to the planner (sort-merge / AQE).
The check is a bounded count (``limit(max_rows + 1)``), so it never scans
more than ``max_rows + 1`` rows of a large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 1_000_000


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count if it is at most ``max_rows``, else ``None``."""
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
                    known_rows: int | None = None) -> DataFrame:
    """Broadcast hint when the size bound holds; plain DataFrame otherwise."""
    n = known_rows if known_rows is not None else bounded_rows(df, max_rows)
    if n is not None and n <= max_rows:
        return F.broadcast(df)
    return df
