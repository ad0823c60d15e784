"""Benchmark decontamination on a distributed positional inverted index.

Index: texts are taken a few MB at a time (a block); each block stores, for every term
of the test set, the word positions at which it occurs.  Terms outside the test set are
screened by a bitmap of fixed size, so what each task carries does not grow with either
table.  The index is written as a table ``(block, term, n, positions)``; texts follow each
other in a block with a gap, so that no match runs across two.

Search: every window of a test item is looked up from its rarest term, rarity being the
term's count over the whole index.  The positions of that term, less its offset in the
window, are the candidate starts; they are intersected with the lists of the next rarer
terms, each less its own offset, until all terms agree.  With ``slop`` the same
intersection also returns proximity matches: each term within ``slop`` words of its place.

A block and one bucket of test items meet in one task: both are bounded (chunk bytes,
items per bucket), whatever source or passage is hot.

Defined cases: a null or empty text has no words and is clean; an item without words
matches nothing; one of fewer than ``size`` words is one window; repeated rows of either
table are handled each on their own (a document row gives one result row); an empty
table on either side gives clean documents; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, only, written
from .words import ALNUM_SPLIT, chunks, signed

WINDOW = 10
SCREEN_BITS = 24           # the bitmap of test terms: 2 MB, whatever the size of the test set
ITEMS_PER_BUCKET = 2000
GAP = 64                   # positions left free between two texts of a block

INDEX = "block long, term long, n long, positions binary, doc_ids binary, firsts binary, lengths binary"
ITEM_TERMS = "item_id string, item long, n_terms int, offset int, term long"
HITS = "doc_id long, row long, item_id string, exact boolean, low long, high long"
HIT_NAMES = ["doc_id", "row", "item_id", "exact", "low", "high"]
HIT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in chunks(batch, "text", ALNUM_SPLIT, lower=True):
            count = np.diff(words.first)
            doc = words.doc
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(doc)), part.column("item").take(pa.array(doc)),
                 pa.array(count[doc].astype(np.int32)),
                 pa.array((np.arange(len(doc)) - words.first[:-1][doc]).astype(np.int32)),
                 pa.array(signed(words.hash))], names=["item_id", "item", "n_terms", "offset", "term"])


def _slot(terms: np.ndarray) -> np.ndarray:
    return (terms.view(np.uint64) >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)


def _screen(terms: DataFrame) -> np.ndarray:
    """Bitmap of the terms, set bits packed; at most ``2**SCREEN_BITS / 64`` rows reach the driver."""
    slot = F.shiftrightunsigned("term", 64 - SCREEN_BITS)
    words = (terms.select(F.shiftright(slot, 6).alias("word"),
                          F.expr(f"shiftleft(1L, int(shiftrightunsigned(term, {64 - SCREEN_BITS}) & 63))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    bitmap = np.zeros(1 << (SCREEN_BITS - 6), dtype="<u8")
    for r in words:
        bitmap[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return bitmap.view(np.uint8)


def _indexer(screen: np.ndarray, gap: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_test_set = np.unpackbits(screen, bitorder="little").astype(bool)
        for batch in batches:
            for part, words in chunks(batch, "text", ALNUM_SPLIT, lower=True):
                doc = words.doc
                at = np.arange(len(doc)) + doc * gap  # position in the block
                known = in_test_set[_slot(words.hash)]
                term, place = signed(words.hash)[known], at[known].astype(np.int32)
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order]
                head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
                ends = np.append(head[1:], len(term))
                # deltas compress well; the first entry is the position itself
                step = np.diff(place, prepend=np.int32(0))
                step[head] = place[head]
                lists = [step[a:b].tobytes() for a, b in zip(head, ends)]
                ids = part.column("doc_id")
                row = part.column("row").to_numpy()
                block = np.full(len(head) + 1, row[0])
                firsts = (words.first[:-1] + np.arange(len(ids)) * gap).astype(np.int64)
                empty = [None] * len(head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(np.append(term[head], 0), mask=np.append(np.zeros(len(head), bool), True)),
                     pa.array(np.append(ends - head, 0)), pa.array([*lists, None], pa.binary()),
                     pa.array([*empty, _ids_bytes(ids, row)], pa.binary()),
                     pa.array([*empty, firsts.tobytes()], pa.binary()),
                     pa.array([*empty, np.diff(words.first).astype(np.int64).tobytes()], pa.binary())],
                    names=["block", "term", "n", "positions", "doc_ids", "firsts", "lengths"])
    return index


def _ids_bytes(ids: pa.Array, row: np.ndarray) -> bytes:
    """Ids, whether they are null, and row numbers, as three runs of int64."""
    null = np.asarray(ids.is_null()).astype(np.int64)
    return np.concatenate([np.asarray(ids.fill_null(0)).astype(np.int64), null, row.astype(np.int64)]).tobytes()


def _near(places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of ``wanted`` have one of the sorted ``places`` within ``slop``."""
    at = np.searchsorted(places, wanted - slop)
    found = at < len(places)
    found[found] = places[at[found]] <= wanted[found] + slop
    return found


def _searcher(size: int, slop: int, gap: int):
    def spans(terms: np.ndarray, freq: np.ndarray, lists: dict[int, np.ndarray], reach: int) -> np.ndarray:
        """Start positions in the block at which some window of the item occurs."""
        n = min(size, len(terms))
        found = [np.zeros(0, np.int64)]
        present = np.array([t in lists for t in terms])
        for i in range(len(terms) - n + 1):
            if not present[i:i + n].all():
                continue
            by_rarity = np.argsort(freq[i:i + n], kind="stable")
            starts = lists[terms[i + by_rarity[0]]] - by_rarity[0]
            for k in by_rarity[1:]:
                if not len(starts):
                    break
                starts = starts[_near(lists[terms[i + k]], starts + k, reach)]
            found.append(starts)
        return np.unique(np.concatenate(found))

    def search(key, index: pa.Table, items: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        known = index.filter(pc.is_valid(index["term"]))
        docs = index.filter(pc.is_null(index["term"]))
        if items.num_rows and docs.num_rows and known.num_rows:
            ids, null, rows = np.frombuffer(docs["doc_ids"][0].as_py(), np.int64).reshape(3, -1)
            firsts = np.frombuffer(docs["firsts"][0].as_py(), np.int64)
            lists = {t: np.cumsum(np.frombuffer(p.as_py(), np.int32), dtype=np.int64)
                     for t, p in zip(known["term"].to_pylist(), known["positions"])}
            items = items.sort_by([("item", "ascending"), ("offset", "ascending")])
            each = np.append(np.flatnonzero(np.diff(items["item"].to_numpy(), prepend=-1)), items.num_rows)
            terms, freq, names = items["term"].to_numpy(), items["freq"].to_numpy(), items["item_id"]
            for a, b in zip(each[:-1], each[1:]):
                for exact, reach in ((True, 0), (False, slop)) if slop else ((True, 0),):
                    low = spans(terms[a:b], freq[a:b], lists, reach)
                    doc = np.maximum(np.searchsorted(firsts, low + reach, side="right") - 1, 0)
                    found = (np.where(null[doc] == 1, None, ids[doc]), rows[doc], np.full(len(low), names[a].as_py(), object),
                             np.full(len(low), exact), low - firsts[doc], low - firsts[doc] + min(size, b - a))
                    for column, values in zip(out, found):
                        column.extend(values.tolist())
        return pa.table([pa.array(c, t) for c, t in zip(out, HIT_TYPES)], names=HIT_NAMES)

    return search


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
            slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(doc_rows, hits)``: ``doc_rows(row, doc_id, n_words)`` of every input row, and window
    occurrences ``hits(row, doc_id, item_id, exact, low, high)`` as word spans of the text."""
    if slop >= GAP // 2:
        raise ValueError("slop must stay below half the gap between texts")
    items = only(benchmark, item_id=item_col, text=item_text_col)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.monotonically_increasing_id().alias("item"), "text")
    terms = written(items.mapInArrow(_items, ITEM_TERMS), "bench-terms")

    rows = only(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    index = written(rows.mapInArrow(_indexer(_screen(terms), GAP), INDEX), "postings")

    freq = index.groupBy("term").agg(F.sum("n").alias("freq"))
    known = written(terms.join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0))), "bench-freq")
    n_items = known.select("item").distinct().count()
    buckets = max(1, -(-n_items // ITEMS_PER_BUCKET))
    bucketed = known.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    # a block meets the items of a bucket that have one of its terms; both sides are keyed
    # by block and bucket, and the text-position row of a block goes to every such pair
    wanted = bucketed.select("term", "bucket").distinct()
    postings = index.filter("term is not null").join(wanted, "term")
    pairs = postings.select("block", "bucket").distinct()
    meta = index.filter("term is null").join(pairs, "block")
    columns = ["block", "bucket", "term", "n", "positions", "doc_ids", "firsts"]
    left = postings.select(*columns).unionByName(meta.select(*columns))
    # items of which the block has the rarest term of some window, whole
    ahead = Window.partitionBy("item").orderBy("offset").rowsBetween(0, size - 1)
    rarest = (bucketed.withColumn("rarest", F.min(F.struct("freq", "term")).over(ahead)["term"])
              .filter((F.col("offset") == 0) | (F.col("offset") + size <= F.col("n_terms")))
              .select("item", "bucket", F.col("rarest").alias("term")).distinct())
    touched = rarest.join(postings.select("block", "bucket", "term"), ["term", "bucket"]).select(
        "block", "bucket", "item").distinct()
    right = touched.join(bucketed, ["bucket", "item"]).select(
        F.col("block").alias("to_block"), F.col("bucket").alias("to_bucket"), "item", "item_id", "offset", "term", "freq")
    hits = written(left.groupBy("block", "bucket").cogroup(right.groupBy("to_block", "to_bucket"))
                   .applyInArrow(_searcher(size, slop, GAP), HITS), "bench-hits")
    return _doc_rows(index), hits


def _doc_rows(index: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths in zip(batch.column("doc_ids"), batch.column("lengths")):
                doc, null, row = np.frombuffer(ids.as_py(), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(doc, mask=null == 1), pa.array(np.frombuffer(lengths.as_py(), np.int64))],
                    names=["row", "doc_id", "n_words"])
    return (index.filter("term is null").select("doc_ids", "lengths")
            .mapInArrow(unpack, "row long, doc_id long, n_words long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Rows ``(id, n_words, n_hit, n_items, items_sha256, contaminated)``, one per input row."""
    rows, hits = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, size)
    hits = hits.filter("exact")
    order = Window.partitionBy("row").orderBy("low", "high")
    before = F.coalesce(F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.select("row", "low", "high").distinct()
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("high") - F.greatest("low", before)))
    n_hit = covered.groupBy("row").agg(F.sum("new").alias("n_hit"))
    ids = F.sort_array(F.collect_set("item_id"))
    n_items = hits.groupBy("row").agg(F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("ids"))
    zero = F.lit(0).cast("long")
    return (rows.join(n_hit.join(n_items, "row"), "row", "left")
            .select(F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                    F.coalesce("n_items", zero).alias("n_items"),
                    F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", zero) > 0).alias("contaminated")))
