"""Ordered sequences per key, cut into even ranges.

``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task,
which fails when one key (source, user, channel) holds a third of the rows, and
time buckets fail when a burst falls into one of them.  ``ordered_parts`` cuts rows
into ranges of (key, order) instead.  Operators then work in three steps: inside each range;
over one small row per range and key (``PART``, ``KEY``), whose number is bounded by
ranges plus keys; and back, with what a range needs to know of those before it (its halo).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

#: The range's number, and the key as one struct (whose null fields are equal to each other in joins).
PART, KEY = "__part", "__key"


def ordered_parts(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` cut into ranges of (keys, order), with ``PART`` and ``KEY``, as a table.

    Ranges have about the same number of rows whatever the keys and times are, as long as ``order_by`` tells
    rows apart.  The table fixes the cut: range bounds are sampled, so two jobs would not
    cut alike.  The rows are written before they are cut, as sampling them would compute them a second time.
    ``parts`` is the number of ranges (by default what the session's shuffles have).
    """
    ranges = written_table(df, "rows").repartitionByRange(*([parts] if parts else []), *keys, *order_by)
    table = written_table(ranges.withColumn(PART, F.spark_partition_id()), "parts")
    return table.withColumn(KEY, F.struct(*keys))


def in_range(*order_by):
    """Rows of one range and key, in order."""
    return Window.partitionBy(PART, KEY).orderBy(*order_by)


def over_ranges():
    """The small rows of one key, range by range."""
    return Window.partitionBy(KEY).orderBy(PART)


def previous_value(df: DataFrame, keys: Sequence[str], ts_col: str, tie: str, value_col: str,
                   out_col: str, parts: int | None = None) -> DataFrame:
    """``lag(value_col)`` per key in (ts, tie) order: inside a range a windowed lag; a range's first row
    of a key takes the last value of the nearest range before it that has the key."""
    rows = ordered_parts(df, keys, [ts_col, tie], parts)
    # as structs, so that a null value is told apart from no row
    value = F.struct(F.col(value_col).alias("value"))
    last = rows.groupBy(PART, KEY).agg(F.max_by(value, F.struct(ts_col, tie)).alias("__last"))
    halo = last.select(PART, KEY, F.lag("__last").over(over_ranges()).alias("__halo"))
    out = rows.withColumn("__lag", F.lag(value).over(in_range(ts_col, tie))).join(halo, [PART, KEY])
    return out.withColumn(out_col, F.coalesce("__lag", "__halo")["value"]).select(*df.columns, out_col)
