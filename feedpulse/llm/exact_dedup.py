"""Exact deduplication by progressive refinement (DataFrame functions only).

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became one
space.  Rows are grouped by the length of that form, then by a hash of its prefix, and
the full hash is taken only of rows that still share both with another row.  Of equal
texts the row with the smallest id stays.

A hot group (a text that holds a third of all rows) is counted with partial
aggregation; its members are joined back to one row of the group, a join that
adaptive execution splits.  Texts themselves are never shuffled unless the
surviving ids outgrow a broadcast.

Defined cases: a null text counts as empty, all empty texts are equal; rows that repeat
an id are the same document (the id stays kept if any of its rows is the smallest);
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written

PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """Rows ``(id, keep_id, group_size, kept)``, one per input row; with ``digest`` also
    ``text_sha256`` of each normalised text, for which the full hash is taken of all rows.
    """
    rows = only(docs, id=id_col, text=text_col).withColumn("text", normalised(F.col("text")))
    prefix = F.xxhash64(F.substring("text", 1, prefix_chars))
    light = rows.select("id", F.length("text").alias("len"), prefix.alias("prefix"),
                        *([F.sha2("text", 256).alias("sha")] if digest else []))
    light = written(light, "dedup-light")

    def shared(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).count().filter("count > 1").drop("count")

    by_len = light.join(shared(light, "len"), "len", "left_semi")
    live = written(by_len.join(shared(by_len, "len", "prefix"), ["len", "prefix"], "left_semi"), "dedup-live")
    if digest:
        hashed = live.select("id", "sha")
    else:
        hashed = written(rows.join(live.select("id").distinct(), "id", "left_semi")
                         .select("id", F.sha2("text", 256).alias("sha")), "dedup-hashed")
    groups = (hashed.groupBy("sha").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
              .filter("size > 1"))
    if digest:
        out = light.join(groups, "sha", "left")
    else:
        members = hashed.join(groups, "sha").select("id", "keep", "size").distinct()
        out = light.join(members, "id", "left")
    keep = F.coalesce("keep", "id")
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                      (keep == F.col("id")).alias("kept"), *([F.col("sha").alias("text_sha256")] if digest else []))
