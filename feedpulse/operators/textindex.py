"""A stored character-trigram index for substring searches (K4-K7).

A search by ``contains`` reads every text.  Here rows are stored in blocks, and for each run of three characters
of the lower-cased text the index lists the rows that have it.  A search reads the lists of the few rarest
trigrams of its query, intersects them, opens only the blocks with a row left, and compares the text itself, so its
rows are exactly those of the scan.

Layout, each folder by run, so that a run adds files only and may be repeated under its name:

* ``rows``, by run and block: the rows as given, and ``__at``, the row's place in its block.  A block is cut inside the
  writing task, so texts are never shuffled.
* ``postings``, by run and bucket: ``(gram, block, places)``, sorted by trigram.  A list ends with its block, so a
  trigram of all rows is many short lists in many tasks.
* ``counts``, by run: rows per trigram, which tell the rarest ones.

Defined cases: a null text is stored and never found; a query of fewer than three characters has no trigram and
is answered by a scan; repeated rows are all found; an empty query is an error, as it would match everything.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..session import checkpoint_dir, removed_at_exit
from .reduction import MAX_KEY_BYTES

#: Three characters: ``grams`` packs them into one long.
GRAM = 3
BLOCK_ROWS = 1 << 14
BUCKETS = 64

#: Lists read for a query, rarest first: another common list costs more than the comparisons it saves.
LISTS = 4

#: Columns that the stored rows carry beside their own.
AT, BLOCK, RUN = "__at", "__block", "__run"
POSTINGS = f"gram long, {BLOCK} string, places array<int>, {RUN} string, bucket int"
COUNTS = f"gram long, n long, {RUN} string"


#: Entries of a block that a task gathers before it sorts them; a list may come in several parts.
GATHERED = 1 << 20


def grams(low: str) -> np.ndarray:
    """Distinct trigrams of a lower-cased text, sorted, each as one number of three 21-bit code points."""
    c = np.frombuffer(low.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(c[:-2] | (c[1:-1] << 21) | (c[2:] << 42))


def query_grams(query: str) -> list[int]:
    return grams(query).tolist()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over ``(block, at, low)``: lists ``(gram, block, places)`` of what was gathered of one block."""
    def lists(block: str, gathered: list[np.ndarray], places: list[int]) -> pa.RecordBatch:
        gram = np.concatenate(gathered)
        place = np.repeat(np.array(places, np.int32), [len(g) for g in gathered])
        order = np.argsort(gram, kind="stable")
        gram, place = gram[order], place[order]
        head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        offsets = np.append(head, len(gram)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[head]), pa.array([block] * len(head), pa.string()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(place))], names=["gram", BLOCK, "places"])

    for batch in batches:
        last, gathered, places, size = None, [], [], 0
        for block, at, low in zip(*batch.columns):
            block = block.as_py()
            if gathered and (block != last or size > GATHERED):
                yield lists(last, gathered, places)
                gathered, places, size = [], [], 0
            last = block
            if low.is_valid:
                gathered.append(grams(low.as_py()))
                places.append(at.as_py())
                size += len(gathered[-1])
        if gathered:
            yield lists(last, gathered, places)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """Rows of one schema under ``path``, searched by substrings of ``lower(text_col)``; without a path they live
    in the session's shared folder until the application ends."""

    def __init__(self, spark: SparkSession, schema, text_col: str = "text", path: str | None = None,
                 block_rows: int = BLOCK_ROWS):
        self.spark, self.text_col, self.block_rows = spark, text_col, block_rows
        if {AT, BLOCK, RUN} & set(schema.fieldNames()):
            raise ValueError(f"{AT}, {BLOCK} and {RUN} are the index's own columns")
        self.schema = schema
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/textindex/{uuid.uuid4().hex[:12]}"
        self._keep = path is not None

    def add(self, rows: DataFrame, run: str = "0") -> "TextIndex":
        """Store and index the rows of a run.  Repeating a run replaces it."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
            raise ValueError(f"a run is named by letters, digits, '_', '.', '-': {run!r}")
        if rows.columns != self.schema.fieldNames():
            raise ValueError(f"columns {rows.columns} are not those of the index")
        # the place within the task: the low 33 bits of the generated id
        number = F.monotonically_increasing_id()
        place = number.bitwiseAND(F.lit((1 << 33) - 1))
        cut = F.concat_ws("-", F.shiftright(number, 33), F.floor(place / self.block_rows))
        stored = rows.select("*", (place % self.block_rows).cast("int").alias(AT), cut.alias(BLOCK))
        stored.write.mode("overwrite").partitionBy(BLOCK).parquet(f"{self.path}/rows/{RUN}={run}")
        if not self._keep:
            removed_at_exit(self.spark, self.path)
            self._keep = True

        mine = self._rows().where(F.col(RUN) == run)
        parts = (mine.select(BLOCK, AT, F.lower(F.col(self.text_col)).alias("low"))
                 .mapInArrow(_parts, f"gram long, {BLOCK} string, places array<int>"))
        lists = (parts.groupBy("gram", BLOCK).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
                 .withColumn("bucket", _bucket(F.col("gram"))))
        (lists.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{RUN}={run}"))
        n = (self._postings().where(F.col(RUN) == run).groupBy("gram")
             .agg(F.sum(F.size("places")).alias("n")))
        n.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/counts/{RUN}={run}")
        return self

    def _rows(self) -> DataFrame:
        schema = StructType(self.schema.fields + [StructField(AT, IntegerType()), StructField(BLOCK, StringType()),
                                                  StructField(RUN, StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def _postings(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All lists, or those of some buckets, whose folders alone are listed."""
        base = f"{self.path}/postings"
        paths = [base] if buckets is None else [f"{base}/{RUN}=*/bucket={b}" for b in buckets]
        return self.spark.read.schema(POSTINGS).option("basePath", base).parquet(*paths)

    def rarest(self, query: str, lists: int = LISTS) -> list[tuple[int, int, int]]:
        """The query's rarest trigrams, rarest first, each with its number of rows and its bucket; a trigram that
        no row has means that nothing matches, and gives an empty list."""
        wanted = query_grams(query)
        n = (self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts").where(F.col("gram").isin(wanted))
             .groupBy("gram").agg(F.sum("n").alias("n")).select("gram", "n", _bucket(F.col("gram"))).collect())
        return sorted(map(tuple, n), key=lambda x: (x[1], x[0]))[:lists] if len(n) == len(wanted) else []

    def candidates(self, rarest: Sequence[tuple[int, int, int]]) -> DataFrame:
        """Rows ``(run, block, at)`` that have all of these trigrams."""
        names, buckets = [g for g, _, _ in rarest], sorted({b for _, _, b in rarest})
        lists = self._postings(buckets).where(F.col("gram").isin(names))
        met = (lists.groupBy(RUN, BLOCK).agg(F.collect_list(F.struct(F.size("places"), "places")).alias("lists"))
               .where(F.size("lists") == len(names)))
        short_first = F.transform(F.sort_array("lists"), lambda x: x["places"])
        both = F.aggregate(F.slice(short_first, 2, len(names)), F.element_at(short_first, 1),
                           lambda a, b: F.array_intersect(a, b))
        return met.select(RUN, BLOCK, F.explode(both).alias(AT))

    def matching(self, query: str) -> DataFrame:
        """The rows whose lower-cased text contains ``query.lower()``."""
        return self.matching_any([query])

    def matching_any(self, queries: Sequence[str]) -> DataFrame:
        """The rows whose lower-cased text contains one of the queries."""
        terms = sorted({x.lower() for x in queries})
        if not terms or not all(terms):
            raise ValueError("query must not be empty")
        low = F.lower(F.col(self.text_col))
        hit = reduce(lambda a, b: a | b, [low.contains(t) for t in terms])
        rows = self._rows()
        if any(len(t) < GRAM for t in terms):
            return rows.where(hit).select(*self.schema.fieldNames())
        found, size = [], 0
        for t in terms:
            rarest = self.rarest(t)
            if rarest:
                found.append(self.candidates(rarest))
                size += rarest[0][1] * 64
        if not found:
            return rows.where(F.lit(False)).select(*self.schema.fieldNames())
        wanted = reduce(DataFrame.union, found)
        wanted = wanted.distinct() if len(found) > 1 else wanted
        # the shortest list bounds the candidates, so their bytes are known before they are computed
        wanted = F.broadcast(wanted) if size <= MAX_KEY_BYTES else wanted
        return rows.join(wanted, [RUN, BLOCK, AT]).where(hit).select(*self.schema.fieldNames())
