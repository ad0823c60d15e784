"""Substring deduplication by seed and extend.

Seeds: every window of ``size`` words is assigned to one anchor, the smallest hash among the
``gram``-word runs inside it (winnowing).  The choice depends on the window's words only, so
equal windows in different texts have equal anchors at the same place; the join of
anchors loses no match.

Extension: an anchor carries one print per window assigned to it, that is, what its text says
before and after the anchor.  Occurrences of an anchor are put side by side, in order of
document, and a match extends over every window whose print an earlier document has as
well.  Unions of matched windows are the maximal repeats of at least ``size`` words.

A word is removed if a window over it also starts in a document with a smaller id.  No pair
of documents is ever formed: an anchor's group is read once, in order, keeping the first
document of each print.  Occurrences that an earlier document of the same chunk already
settles are settled there and don't enter the shuffle, so that a passage or copy found in a
third of all rows sends one row per chunk, and Spark's external sort holds what is left.

Defined cases: a null or empty text has no words; a text shorter than ``size`` words loses
none; rows that repeat an id are separate texts of one document (neither is smaller than
the other); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .words import BLANK_SPLIT, Words, chunks, mix, signed

SIZE, GRAM = 13, 6

#: place: the anchor's first word; mask: bit i for the window that starts i words before it, set
#: where that window repeats; prints: of the windows not judged yet.
ANCHORS = "anchor long, doc long, twin long, place long, prints binary, mask int"
FOUND = "doc long, twin long, place long, mask int"


def _last_smallest(grams: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of ``span`` grams from each start, the last one among equals."""
    best, at = grams[starts], starts.copy()
    for i in range(1, span):
        here = grams[starts + i]
        better = here <= best
        best = np.where(better, here, best)
        at[better] = starts[better] + i
    return at


def anchors_of(words: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position, hash, prints)`` of the anchors; ``prints[k, i]`` is that of the window which
    starts ``i`` words before anchor ``k``, 0 where that window is not assigned to it."""
    span = size - gram + 1
    starts = np.flatnonzero(words.fits(size))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, span), np.uint64)
    grams = words.windows(gram)
    at = _last_smallest(grams, starts, span)
    whole = mix(words.windows(size)[starts] ^ np.uint64(0x5851F42D4C957F2D))
    prints = np.where(whole == 0, np.uint64(1), whole)
    position, owner = np.unique(at, return_inverse=True)
    table = np.zeros((len(position), span), dtype=np.uint64)
    table[owner, at - starts] = prints
    return position, grams[position], table


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _settled_here(hashes: np.ndarray, table: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document of the chunk has the same anchor with the same prints."""
    factors = np.arange(table.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)
    key = mix(hashes ^ mix((table * factors).sum(1, dtype=np.uint64)))
    order = np.lexsort((doc, key))
    head = np.append(True, key[order][1:] != key[order][:-1])
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    same = (hashes[order] == hashes[first]) & (table[order] == table[first]).all(1)
    out = np.zeros(len(doc), dtype=bool)
    out[order] = same & (doc[first] < doc[order])
    return out


def _seeder(size: int, gram: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text", BLANK_SPLIT):
                position, hashes, table = anchors_of(words, size, gram)
                if not len(position):
                    continue
                row = np.searchsorted(words.first, position, side="right") - 1
                doc = part.column("doc").to_numpy()[row]
                twin = part.column("twin").to_numpy()[row]
                place = position - words.first[row]
                done = _settled_here(hashes, table, doc)
                mask = ((table != 0) << np.arange(table.shape[1])).sum(1).astype(np.int32)
                # settled rows only pass through; they are dealt out evenly
                key = np.where(done, mix(position.astype(np.uint64) ^ hashes ^ doc.view(np.uint64)), hashes)
                prints = _binary(np.where(done[:, None], np.uint64(0), table))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(doc), pa.array(twin), pa.array(place), prints,
                     pa.array(np.where(done, mask, 0).astype(np.int32))],
                    names=["anchor", "doc", "twin", "place", "prints", "mask"])
    return seed


def _first_docs(group: np.ndarray, prints: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each (group, print): the first document; entries come in order of document."""
    if not len(doc):
        return doc
    order = np.lexsort((prints, group))  # stable, so documents stay in order
    g, p = group[order], prints[order]
    head = np.append(True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]))
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = doc[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    return out


def _extender(span: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and document; a group may run over batches."""
        last_anchor, seen = None, {}  # the group that may go on: first document of each print
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            doc, twin = batch.column("doc").to_numpy(), batch.column("twin").to_numpy()
            place = batch.column("place").to_numpy()
            mask = batch.column("mask").to_numpy().astype(np.int64)
            prints = batch.column("prints")
            table = np.frombuffer(prints.buffers()[2], dtype=np.uint64)
            table = table[prints.offset * span:(prints.offset + len(prints)) * span].reshape(-1, span)
            head = np.append(True, anchor[1:] != anchor[:-1])
            group = np.cumsum(head) - 1
            goes_on = seen if last_anchor == anchor[0] else {}
            # groups with one document can't match; the first and last may have more rows elsewhere
            begin = np.flatnonzero(head)
            end = np.append(begin[1:], len(anchor))
            shared = doc[begin] != doc[end - 1]
            shared[[0, -1]] = True
            row = np.flatnonzero(shared[group] & (mask == 0))
            r, i = np.nonzero(table[row])
            r = row[r]
            value = table[r, i]
            first = _first_docs(group[r], value, doc[r])
            if goes_on:
                for k in np.flatnonzero(group[r] == 0):
                    first[k] = min(first[k], goes_on.get(value[k], first[k]))
            repeat = first < doc[r]
            np.add.at(mask, r[repeat], np.int64(1) << i[repeat])
            hit = np.flatnonzero(mask)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[hit]), pa.array(twin[hit]), pa.array(place[hit]), pa.array(mask[hit].astype(np.int32))],
                    names=["doc", "twin", "place", "mask"])
            tail = group[r] == group[-1]
            seen = goes_on if group[-1] == 0 else {}
            last_anchor = anchor[-1]
            for v, d in zip(value[tail].tolist(), first[tail].tolist()):
                seen.setdefault(v, d)
    return extend


def _remover(size: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for text, places, masks in zip(batch.column("text"), batch.column("places"), batch.column("masks")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                kept = words
                if places.is_valid:
                    place = np.asarray(places.values)
                    mask = np.asarray(masks.values)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for i in range(int(mask.max()).bit_length()):
                        start = place[(mask >> i) & 1 == 1] - i
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + size, -1)
                    kept = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(kept)
            texts = [b" ".join(k) for k in digests]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                 *([pa.array([t.decode() for t in texts], pa.string())] if with_text else [])],
                names=["doc", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])
    return remove


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``docs(doc, twin, text)`` -> matched windows as rows ``(doc, twin, place, mask)``."""
    seeds = docs.mapInArrow(_seeder(size, gram), ANCHORS)
    ordered = seeds.repartition("anchor").sortWithinPartitions("anchor", "doc")
    return ordered.mapInArrow(_extender(size - gram + 1), FOUND)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                   gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Rows ``(id, n_words, n_removed, kept_sha256)``, one per input row, and ``kept_text``."""
    rows = only(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    twins = rows.groupBy("doc").count().filter("count > 1 or doc is null").limit(1).count()
    # the text tells rows of one id apart; a null id counts as larger than any other
    rows = rows.withColumn("twin", F.xxhash64("text") if twins else F.lit(0).cast("long"))
    rows = rows.withColumn("key", F.coalesce("doc", F.lit((1 << 63) - 1)))
    found = repeats(rows.select(F.col("key").alias("doc"), "twin", "text"), size, gram)
    found = written(found, "repeats")
    per_doc = (found.groupBy(F.col("doc").alias("key"), "twin")
               .agg(F.collect_list("place").alias("places"), F.collect_list("mask").alias("masks")))
    out = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return (rows.join(per_doc, ["key", "twin"], "left").select("doc", "text", "places", "masks")
            .mapInArrow(_remover(size, with_text), out).withColumnRenamed("doc", id_col))
