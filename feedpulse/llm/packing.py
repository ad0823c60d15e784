"""Best-fit packing of documents into fixed-length training sequences, under conflicts.

A document longer than a sequence is cut into full pieces and a rest; nothing is dropped.
Full pieces are sequences of their own.  The others are packed longest first: each goes to
the open bin with the smallest sufficient room that it doesn't conflict with.  Documents
conflict if they share a source or a cluster of duplicates; every bin carries a bitmap of
its sources and one of its clusters.  Bins are ordered by room; the search starts at the
piece's length and steps to the next larger room until a compatible bin is found, so the
result is the tightest compatible bin, and a new one is opened only if there is none.

Packing is a sequential loop, so it runs on parts: rows are dealt to parts of about ``PART_ROWS``
rows by a hash of the id, in numbers that grow with the table.  A source that holds a
third of all rows, or a large cluster, is spread over all parts.  Bins never span parts.

Defined cases: a null or empty text has length 1 (its separator) and is packed; null
sources and clusters conflict with nothing; of documents of equal length the one with the
smaller id goes first (null first), repeated rows in any order; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written

CAPACITY = 2048
PART_ROWS = 8192
PACKED = "doc long, piece int, n_pieces int, length int, part int, bin int, offset int"


def word_count(text: Column) -> Column:
    """Words of a text and one separator."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")) + 1


class Bins:
    """Open bins by room.  Bins of one room with the same source bitmap are one group, so a
    source that fills many bins is passed over group by group, not bin by bin."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms = 0  # bit r: some bin has room r
        self.groups: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(capacity + 1)]
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; ``source`` and ``cluster`` are one-bit maps, or 0."""
        rest = self.rooms >> length
        room = length
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            found = self._take(room, source, cluster)
            if found:
                number, sources, clusters = found
                return self._put(number, room, length, sources | source, clusters | cluster)
            rest >>= step + 1
            room += 1
        self.used.append(0)
        return self._put(len(self.used) - 1, self.capacity, length, source, cluster)

    def _take(self, room: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        groups = self.groups[room]
        for sources, bins in groups.items():
            if sources & source:
                continue
            for at in range(len(bins) - 1, -1, -1):
                number, clusters = bins[at]
                if not clusters & cluster:
                    bins.pop(at)
                    if not bins:
                        del groups[sources]
                        if not groups:
                            self.rooms &= ~(1 << room)
                    return number, sources, clusters
        return None

    def _put(self, number: int, room: int, length: int, sources: int, clusters: int) -> tuple[int, int]:
        offset = self.used[number]
        self.used[number] += length
        left = room - length
        if left:
            self.groups[left].setdefault(sources, []).append((number, clusters))
            self.rooms |= 1 << left
        return number, offset


def bitmaps(values: Iterable, shared_only: bool) -> list[int]:
    """One bit per distinct value, 0 for nulls (and, if asked, for values that occur once)."""
    values = [None if pd.isna(v) else v for v in values]
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    bits: dict = {}
    for v, n in seen.items():
        if v is not None and (n > 1 or not shared_only):
            bits[v] = 1 << len(bits)
    return [bits.get(v, 0) for v in values]


def _packer(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rest", "doc"], ascending=[False, True], na_position="first", kind="stable")
        sources, clusters = bitmaps(rows.source, False), bitmaps(rows.cluster, True)
        bins, out = Bins(capacity), []
        for doc, length, source, cluster in zip(rows.doc, rows.length, sources, clusters):
            full, rest = divmod(length, capacity)
            pieces = full + (rest > 0)
            doc = None if pd.isna(doc) else int(doc)
            for k in range(full):
                bins.used.append(capacity)
                out.append((doc, k, pieces, capacity, len(bins.used) - 1, 0))
            if rest:
                out.append((doc, full, pieces, rest, *bins.place(rest, source, cluster)))
        packed = pd.DataFrame(out, columns=["doc", "piece", "n_pieces", "length", "bin", "offset"])
        packed["part"] = int(rows.part.iloc[0])
        packed["doc"] = packed["doc"].astype("Int64")
        return packed
    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster_col: str | None = None, capacity: int = CAPACITY, length: Column | None = None,
         part_rows: int = PART_ROWS) -> DataFrame:
    """Rows ``(id, piece, n_pieces, length, part, bin, offset)``: one per piece of a document.

    ``part`` and ``bin`` name the sequence.  ``cluster_col`` holds duplicate clusters; without it,
    documents of equal text are a cluster.  ``length`` is a column over ``text`` (words by default).
    """
    rows = only(docs, doc=id_col, text=text_col, source=source_col, **({"cluster": cluster_col} if cluster_col else {}))
    cluster = F.col("cluster").cast("string") if cluster_col else F.when(F.length("text") > 0, F.md5("text"))
    size = length if length is not None else word_count(F.col("text"))
    light = written(rows.select(F.col("doc").cast("long").alias("doc"), F.col("source").cast("string").alias("source"),
                                F.xxhash64("text").alias("salt"), cluster.alias("cluster"), size.cast("int").alias("length")),
                    "pack-lengths")
    parts = max(1, math.ceil(light.count() / part_rows))
    dealt = (light.withColumn("part", F.pmod(F.xxhash64("doc", F.when(F.col("doc").isNull(), F.col("salt"))), F.lit(parts)).cast("int"))
             .withColumn("rest", F.col("length") % capacity).drop("salt"))
    return dealt.groupBy("part").applyInPandas(_packer(capacity), PACKED).withColumnRenamed("doc", id_col)
