"""Sharding by longest-processing-time scheduling under the law ``bytes``.

Rows of equal texts are one group and stay together.  Groups, sorted by size, go to
the least-loaded shard through a heap.  A heap is one sequential loop, so its input
has a fixed bound: a group above ``total / cells`` bytes is an item of its own (there
can be fewer than ``cells`` of these), and all smaller groups are summed into
``cells`` hash cells, each of which is an item.  Sizes are summed with partial
aggregation, so a text that holds a third of all rows arrives as one sum; the
assignment (at most ``2 * cells`` rows) is joined back to the rows.

Slots count up without gaps inside a shard.  They are not taken in one window over a
shard: rows are dealt to ``cells`` parts by a hash of the id, numbered inside each
part, and shifted by the counts of the parts before (``shards * cells`` rows).

Defined cases: a null text has no bytes, size 1, checksum 0, and is in one group with the
empty text; a null id is a row like others; repeated rows are equal texts and go
together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

SHARDS, CELLS = 8, 4096


def longest_first(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """item -> shard for ``(size, item)``: largest first, each to the least-loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(loads)
        out[item] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          cells: int = CELLS) -> DataFrame:
    """Rows ``(id, size, text_crc32, shard, slot)``, one per input row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = written(only(docs, id=id_col, text=text_col).select(
        "id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("group"), F.pmod(F.xxhash64("id"), F.lit(cells)).alias("part")), "shard-rows")

    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    cell = F.pmod(F.col("group"), F.lit(cells))
    large = F.col("bytes") > F.lit(total / cells)
    # items: -1 - cell for a cell of small groups, else the rank of a large group
    heavy = groups.filter(large).select("group", "bytes")
    light = groups.filter(~large).groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))
    own = sorted((-r["bytes"], r["group"]) for r in heavy.collect())  # fewer than `cells` rows
    items = [(-size, k) for k, (size, _) in enumerate(own)]
    items += [(r["bytes"], -1 - r["cell"]) for r in light.collect()]  # at most `cells` rows
    at = longest_first(items, shards)

    heavy_at = spark.createDataFrame([(g, at[k]) for k, (_, g) in enumerate(own)], "group long, own int")
    light_at = spark.createDataFrame([(-1 - i, s) for i, s in at.items() if i < 0], "cell long, common int")
    placed = written(
        rows.withColumn("cell", cell).join(F.broadcast(heavy_at), "group", "left")
        .join(F.broadcast(light_at), "cell", "left")
        .select("id", "size", "crc", "part", F.coalesce("own", "common").alias("shard")), "shard-placed")

    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc"))
    return (placed.withColumn("nth", inside).join(F.broadcast(starts), ["shard", "part"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("base") + F.col("nth") - 1).cast("long").alias("slot")))
