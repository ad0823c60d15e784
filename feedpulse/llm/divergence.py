"""Source divergence audit: how far the sources of a language differ in their words.

Late string materialization.  One pass counts terms; what it writes is a table of fixed-width
rows ``(lang, source, digest, n, docs)`` and, apart from them, one spelling per digest and
scanned part.  All shuffles that grow with the corpus carry the 64-bit digests.  A grouped
minimum and maximum over the spellings finds digests that stand for more than one
string; only their rows get the string back, by (part, digest), and are split by
it.  Texts of all other terms are joined to the rows of the result only.

Law (all in integers): a language keeps the V terms that occur in at least ``min_docs`` of its
documents.  With N occurrences of kept terms in a group, a term with ``n`` of them has
``p = 1 + floor(SCALE * (n + 1) / (N + V))``, and ``f(p, q) = floor((p - q)^2 / q)``.

* part ``pair``: for each other source of the language, f summed over all kept terms;
* part ``term``: kept terms of the group with more than the language's share, the first ``top``.

The sums over pairs deal the kept terms of a language out to buckets of about ``BUCKET`` counts and
add blocks of terms by sources up in numpy inside tasks; a task returns rows per pair of sources,
never per term.  Sources are cut into tiles of ``TILE``, so that a task's sums stay small.

Defined cases: a null text, language or source reads as ''; a text without letters has no terms, but
its group is there; a language with no kept terms has V = 0, value 0 for its pairs and no
``term`` rows; a language with one source has no pairs; rows that repeat an id are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written
from .words import ALPHA_SPLIT, signed, slices, string_hashes, text_buffers, word_strings

SCALE, MIN_DOCS, TOP, DIGEST_BITS = 1_000_000_000, 3, 200, 64
#: Sources in a tile, counts in a bucket (about), and numbers in a block of terms by sources.
TILE, BUCKET, CELLS = 256, 1 << 16, 1 << 18
CHUNK_BYTES, PART_BYTES = 1 << 23, 1 << 25

#: Rows of counts (``own`` only where the part has several strings of that digest), and rows of spellings.
COUNTED = "part long, lang string, source string, digest long, n long, docs long, own string, spelling string"


class _Part:
    """Counts of the texts since the last rows were sent."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms = pa.array([], pa.large_string())
        self.keys = self.n = self.docs = np.zeros(0, np.int64)
        self.bytes = 0

    def add(self, words: pa.Array, first: np.ndarray, group: np.ndarray) -> None:
        found = words.dictionary_encode()
        both = pa.concat_arrays([self.terms, found.dictionary]).dictionary_encode()
        place = both.indices.to_numpy()[len(self.terms):]  # of the new terms among all
        self.terms = both.dictionary
        doc = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
        pair, n = np.unique((doc << 32) | place[found.indices.to_numpy()], return_counts=True)
        keys = (group[pair >> 32] << 32) | (pair & 0xFFFFFFFF)
        self._merge(keys, n, np.ones(len(keys), np.int64))

    def _merge(self, keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        keys, n, docs = (np.concatenate(x) for x in ((self.keys, keys), (self.n, n), (self.docs, docs)))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
        self.keys = keys[head]
        self.n, self.docs = (np.add.reduceat(x[order], head) if len(head) else x for x in (n, docs))

    def rows(self, number: int, mask: np.uint64) -> Iterator[pa.RecordBatch]:
        digest = string_hashes(self.terms) & mask
        _, place, times = np.unique(digest, return_inverse=True, return_counts=True)
        shared = times[place] > 1
        term, group = self.keys & 0xFFFFFFFF, self.keys >> 32
        names = list(self.groups)
        pick = pa.array(group)

        def column(i):
            return pa.array([x[i] for x in names], pa.string()).take(pick)
        own = pa.compute.if_else(pa.array(shared[term]), self.terms.take(pa.array(term)), None).cast(pa.string())
        yield self._batch(number, len(term), lang=column(0), source=column(1), digest=pa.array(signed(digest[term])),
                          n=pa.array(self.n), docs=pa.array(self.docs), own=own)
        yield self._batch(number, len(digest), digest=pa.array(signed(digest)), spelling=self.terms.cast(pa.string()))

    @staticmethod
    def _batch(number: int, rows: int, **given: pa.Array) -> pa.RecordBatch:
        kinds = {"part": pa.int64(), "lang": pa.string(), "source": pa.string(), "digest": pa.int64(), "n": pa.int64(),
                 "docs": pa.int64(), "own": pa.string(), "spelling": pa.string()}
        given["part"] = pa.array(np.full(rows, number))
        return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(rows, v)) for k, v in kinds.items()], names=list(kinds))


def _counter(bits: int, part_bytes: int):
    mask = np.uint64((1 << bits) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = TaskContext.get().partitionId() << 32, _Part()
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_buffers(batch.column("text"))
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            for row, upto in slices(offsets, CHUNK_BYTES):
                group = np.array([part.groups.setdefault(g, len(part.groups)) for g in groups[row:upto]], dtype=np.int64)
                at = offsets[row:upto + 1]
                part.add(*word_strings(data[at[0]:at[-1]], at - at[0], ALPHA_SPLIT, lower=True), group)
                part.bytes += int(at[-1] - at[0])
                if part.bytes >= part_bytes:
                    yield from part.rows(number, mask)
                    number, part = number + 1, _Part()
        yield from part.rows(number, mask)
    return count


def term_counts(docs: DataFrame, digest_bits: int = DIGEST_BITS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """``docs(lang, source, text)`` -> counts ``(lang, source, digest, split, n, docs)`` by part, and
    spellings ``(digest, split, term)``.  ``split`` is '' but for digests of several strings."""
    counted = written(docs.mapInArrow(_counter(digest_bits, part_bytes), COUNTED), "term-parts")
    spelt = counted.filter("spelling is not null").select("part", "digest", "spelling")
    spelling = written(spelt.groupBy("digest").agg(F.min("spelling").alias("term"), F.max("spelling").alias("last")), "spellings")
    # a table of its own, so that its size is known when the counts are joined with it
    several = written(spelling.filter("term <> last").select("digest"), "several")
    rows = counted.filter("n is not null").drop("spelling")
    plain = rows.join(several, "digest", "left_anti").withColumn("split", F.lit(""))
    # a part that holds one string of the digest names it in its spellings, else in its rows
    mixed = rows.join(several, "digest", "left_semi")
    named = mixed.join(spelt.join(several, "digest", "left_semi"), ["part", "digest"], "left")
    named = (mixed.filter("own is not null").withColumn("split", F.col("own"))
             .unionByName(named.filter("own is null").withColumn("split", F.col("spelling")).drop("spelling")))
    keys = ["lang", "source", "digest", "split"]
    counts = plain.select(*keys, "n", "docs").unionByName(named.select(*keys, "n", "docs"))
    split_up = spelt.join(several, "digest", "left_semi").select("digest", F.col("spelling").alias("split")).distinct()
    terms = (spelling.filter("term = last").select("digest", F.lit("").alias("split"), "term")
             .unionByName(split_up.withColumn("term", F.col("split"))))
    return counts, terms


def share(n: Column, total: Column, kinds: Column) -> Column:
    """p as an exact integer; where the product passes 64 bits, it is a decimal."""
    wide = "decimal(38,0)"
    p = F.when(n < 1 << 33, F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), total + kinds))
    return p.otherwise(F.call_function("div", (n.cast(wide) + 1) * F.lit(SCALE).cast(wide), (total + kinds).cast(wide))) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """``terms(digest, split, place, p)``: counts of one bucket of a language's kept terms, and its
    ``groups(lang, tile, place, absent)`` with p of a term they lack -> f summed over the terms,
    for the groups of the tile against all: rows ``(lang, place, values)``."""
    lang, tile = groups.column("lang")[0].as_py(), groups.column("tile")[0].as_py()
    absent = np.empty(len(groups), np.int64)
    absent[groups.column("place").to_numpy()] = groups.column("absent").to_numpy()
    mine = slice(tile * TILE, min((tile + 1) * TILE, len(absent)))
    sums = np.zeros((mine.stop - mine.start, len(absent)), np.int64)
    if len(terms):
        split = terms.column("split").combine_chunks().dictionary_encode().indices.to_numpy()
        digest, place, p = (terms.column(c).to_numpy() for c in ("digest", "place", "p"))
        order = np.lexsort((split, digest))
        digest, split, place, p = digest[order], split[order], place[order], p[order]
        term = np.cumsum(np.append(False, (digest[1:] != digest[:-1]) | (split[1:] != split[:-1])))
        block = max(1, CELLS // len(absent))
        for first in range(0, int(term[-1]) + 1, block):
            a, b = np.searchsorted(term, [first, first + block])
            table = np.repeat(absent[:, None], term[b - 1] + 1 - first, axis=1)
            table[place[a:b], term[a:b] - first] = p[a:b]
            for k, row in enumerate(table[mine]):
                d = row - table
                sums[k] += (d * d // table).sum(1)
    return pa.table({"lang": pa.array([lang] * len(sums), pa.string()),
                     "place": pa.array(np.arange(mine.start, mine.stop, dtype=np.int64)),
                     "values": pa.array(list(sums), pa.list_(pa.int64()))})


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = DIGEST_BITS,
               part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``."""
    docs = only(docs, lang=lang_col, source=source_col, text=text_col).fillna("")
    counts, terms = term_counts(docs, digest_bits, part_bytes)
    key = ["digest", "split"]

    # one shuffle by term serves the sums by source, the language's counts and the choice of kept terms
    of_term = Window.partitionBy("lang", *key)
    summed = (counts.repartition("lang", *key).groupBy("lang", *key, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    used = written(summed.withColumns({"of_lang": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term),
                                       "kind": (F.row_number().over(of_term.orderBy("source")) == 1).cast("int")})
                   .filter(F.col("in_docs") >= min_docs).drop("docs", "in_docs"), "kept-counts")
    langs = used.groupBy("lang").agg(F.sum("kind").alias("kinds"), F.sum("n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # buckets of a language's counts; all that its rows need to know of it comes with their group
    rooms = used.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(BUCKET)).alias("buckets"))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = (docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .join(rooms, "lang", "left").fillna(0, ["total", "kinds", "lang_total", "buckets"])
              .withColumns({"place": place, "sources": F.count("*").over(Window.partitionBy("lang"))}))
    groups = written(groups, "groups")
    shares = used.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))

    q = share(F.col("of_lang"), F.col("lang_total"), F.col("kinds"))
    over = shares.withColumn("q", q).filter("p > q").withColumn("value", apart(F.col("p"), F.col("q")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # with all that tie at the last place: the text decides among these
    near = over.withColumn("nth", F.rank().over(by_value)).filter(F.col("nth") <= top)
    near = near.select("lang", "source", *key, "value").join(terms, key)
    best = near.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by_text = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(by_text)).filter(F.col("rank") <= top)

    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE)))
    terms_in = (shares.withColumn("tile", cut)
                .select("lang", "tile", F.pmod("digest", "buckets").alias("bucket"), "digest", "split", "place", "p"))
    groups_in = (groups.filter("buckets > 0").withColumn("tile", cut)
                 .withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
                 .select(*[F.col(c).alias(c) for c in ("lang", "tile", "bucket", "place")],  # names of their own
                         share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")).alias("absent")))
    at = ["lang", "tile", "bucket"]
    sums = (terms_in.groupBy(*at).cogroup(groups_in.groupBy(*at))
            .applyInArrow(_pair_sums, "lang string, place long, values array<long>")
            .select("lang", "place", F.posexplode("values").alias("other", "value")))
    sums = sums.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"))
    pairs = (groups.select("lang", "source", "place").join(other, "lang").filter("place <> other")
             .join(sums, ["lang", "place", "other"], "left").fillna(0, ["value"]))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    return pairs.unionByName(best)
