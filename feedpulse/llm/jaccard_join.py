"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set are its distinct ``n``-word shingles.  Sets are dealt into size bands; the
shingles of a band's sets are hashed into segments.  Two sets of one band that link differ
in at most ``H`` shingles, so with enough segments some segment of both holds the same
shingles.  Each set is indexed under the contents of its non-empty segments, once with the
segments of its own band and once with those of the next, where its larger partners are.
Some segments of short sets are also indexed under each content with one shingle
deleted; such a segment covers two differences.

Allocation by cost: how many segments a band has, and how many of these carry deletions,
is the cheapest choice that covers ``H + 1`` differences with some slack.  Then each set spends
its slack: it does not probe the segments with the longest lists, as long as what is left
still covers ``H + 1``.  A pair meets if either side probes a segment in which both agree.
A set whose non-empty segments can't cover its differences also goes under every shingle.

Candidates pass a filter that loses nothing: each set has a bitmap of the parities of its shingles'
hashes, and two bitmaps never differ in more bits than the sets differ in shingles.  The
filter is part of the join condition, so a list of many unlike sets sends few pairs on.

Verification is exact, on sorted shingle sets.  Equal sets are one class before the join
(only the class is joined).  In a list, all members are first paired with its smallest
one; a list whose members are then in one component is done.  In the others, members of
different components are paired with those that probe the list and verified too, first in a
share of the lists, then, with the components found so far, in all.  So no link between
components is lost, while a large group of near copies costs its size, not its square.

Shingles and sets are told apart by 64-bit hashes.

Defined cases: a null text or one without words has no shingles and is linked with nothing;
fewer than ``n`` words are one shingle; rows that repeat an id are linked like other rows and get
that id's component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, only, written
from .words import BLANK_SPLIT, Words, chunks, mix, signed

SHINGLE = 5
#: Similarity of at least 80 / 100: sets of sizes a and b differ in at most (a + b) // 9.
PERCENT = 80
SLACK = 1.1          # covered differences over the needed ones
PAIR_COST, COMMON = 20.0, 0.3  # of the allocation: a chance match against an index row; share of common shingles

EXACT, WITH_DELETIONS, DELETION, SINGLE = 0, 1, 2, 3
HELD_ROWS = 100_000  # of one list that a task holds to know whether it has several keys
NULL_ID = (1 << 63) - 1
#: Pairs between components are sought in one in so many lists, then in the next share.
LIST_SHARES = (8, 1)
SKETCH_LONGS = 16  # 1024 parity bits of a set
SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]
SIGNATURES = "sig long, key long, band int, kind int, slack int"


def differences(total: int | np.ndarray) -> int | np.ndarray:
    """Most shingles in which two linked sets differ whose sizes sum to ``total``."""
    return total * (100 - PERCENT) // (100 + PERCENT)


def _band_tops() -> tuple[int, ...]:
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // PERCENT))
    return tuple(tops)


#: Largest size of each band: a set's partners are in its band and the ones beside it.
BAND_TOPS = _band_tops()
#: What ``allocation`` found so far.  A plain dictionary, which travels to workers by value.
_ALLOCATED: dict[int, tuple[int, int]] = {}


def band_tops() -> tuple[int, ...]:
    return BAND_TOPS


def allocation(band: int) -> tuple[int, int]:
    """``(segments, of these with deletions)`` of a band at the least cost."""
    if band not in _ALLOCATED:
        _ALLOCATED[band] = _allocation(band)
    return _ALLOCATED[band]


def _allocation(band: int) -> tuple[int, int]:
    top = BAND_TOPS[band]
    need = math.ceil(SLACK * (differences(2 * top) + 1)) + 2
    best = None
    for deletions in range(min(need // 2, 4) + 1):
        exact = need - 2 * deletions
        segments = exact + deletions
        if not segments:
            continue
        each = top / segments
        cost = exact + deletions * (1 + each) + PAIR_COST * segments * COMMON ** each
        if best is None or cost < best[0]:
            best = (cost, segments, deletions)
    return best[1], best[2]


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, shingle)``, distinct, sorted by both; owner is the text's place in the chunk."""
    count = np.diff(words.first)
    owner = words.doc[words.fits(n)]
    shingle = words.windows(n)[words.fits(n)]
    short = np.flatnonzero((count > 0) & (count < n))
    owner = np.concatenate([owner, short])
    shingle = np.concatenate([shingle, words.whole()[short]])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def _keys(owner: np.ndarray, shingle: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of each text's set."""
    size = np.bincount(owner, minlength=texts)
    total = np.zeros(len(shingle) + 1, dtype=np.uint64)
    np.cumsum(mix(shingle ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64, out=total[1:])
    end = np.cumsum(size)
    return size, signed(mix((total[end] - total[end - size]) ^ size.astype(np.uint64)))


def sketches(owner: np.ndarray, shingle: np.ndarray, texts: int) -> np.ndarray:
    """Per text: parity of its shingles in each of the bitmap's places, as rows of int64."""
    bits = SKETCH_LONGS * 64
    place = (mix(shingle ^ np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(owner * bits + place, minlength=texts * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(texts, bits), axis=1).view(np.int64)


def _size_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text", BLANK_SPLIT, lower=True):
                owner, shingle = shingle_sets(words, n)
                size, key = _keys(owner, shingle, part.num_rows)
                sketch = np.ascontiguousarray(sketches(owner, shingle, part.num_rows).T)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(size.astype(np.int64)), pa.array(key), *map(pa.array, sketch)],
                    names=["doc", "size", "key", *SKETCH])
    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, "text", BLANK_SPLIT, lower=True):
                owner, shingle = shingle_sets(words, n)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                sets = [shingle[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                # another row of the same id may hold another text
                same = pa.array(_keys(owner, shingle, part.num_rows)[1] == part.column("key").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.binary())],
                                                 names=["key", "shingles"]).filter(same)
    return run


def signatures(owner: np.ndarray, shingle: np.ndarray, size: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """``(owner, sig, band, kind, slack)`` of sets under the segments of their band (``step`` 0) or
    the next (1)."""
    tops = np.array(band_tops(), dtype=np.int64)
    band = np.searchsorted(tops, size) + step
    largest = np.minimum(tops[band], size * 100 // PERCENT)
    spread = differences(size + largest)
    # no partner in the next band, or no difference allowed: nothing to look for
    active = (spread >= 1) & (size > 0)
    if step:
        active &= largest > tops[band - 1]
    use = active[owner]
    owner, shingle = owner[use], shingle[use]
    none = np.zeros(0, np.int64)
    if not len(owner):
        return none, none.view(np.uint64), none, none, none
    plans = np.array([allocation(b) if a else (1, 0) for b, a in zip(band.tolist(), active.tolist())], dtype=np.int64)
    segments, deletions = plans[:, 0], plans[:, 1]
    mixed = mix(shingle ^ np.uint64(0x2545F4914F6CDD1D))
    segment = ((mixed >> np.uint64(33)) % segments[owner].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((segment, owner))
    owner, segment, shingle, mixed = owner[order], segment[order], shingle[order], mixed[order]
    head = np.ones(len(owner), dtype=bool)
    head[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    begin = np.flatnonzero(head)
    length = np.diff(np.append(begin, len(owner)))
    content = np.add.reduceat(mixed, begin)
    who, where = owner[begin], segment[begin]
    place = mix(band[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + where.astype(np.uint64))
    kind = np.where(where < deletions[who], WITH_DELETIONS, EXACT)
    sig = mix(content ^ place)

    covers = np.where((kind == WITH_DELETIONS) & (length > 1), 2, 1)
    slack = np.bincount(who, weights=covers, minlength=len(size)).astype(np.int64) - (spread + 1)

    # contents with one shingle deleted
    of = np.repeat(np.arange(len(begin)), length)
    less = (kind[of] == WITH_DELETIONS) & (length[of] > 1)
    parent = of[less]
    without = mix((content[parent] - mixed[less]) ^ place[parent])
    # sets that their segments don't cover
    lone = slack[owner] < 0
    single = mix(shingle[lone] ^ mix(band[owner[lone]].astype(np.uint64) ^ np.uint64(0xFF51AFD7ED558CCD)))
    out_owner = np.concatenate([who, who[parent], owner[lone]])
    return (out_owner, np.concatenate([sig, without, single]), band[out_owner],
            np.concatenate([kind, np.full(len(parent), DELETION), np.full(len(single), SINGLE)]),
            np.maximum(slack, 0)[out_owner])


def _signature_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # sets this task has signed; equal ones need not be signed again
        for batch in batches:
            for part, words in chunks(batch, "text", BLANK_SPLIT, lower=True):
                owner, shingle = shingle_sets(words, n)
                size, key = _keys(owner, shingle, part.num_rows)
                fresh = np.zeros(part.num_rows, dtype=bool)
                for i, k in enumerate(key.tolist()):
                    if k not in done:
                        done.add(k)
                        fresh[i] = True
                owner, shingle = owner[fresh[owner]], shingle[fresh[owner]]
                size = np.where(fresh, size, 0)
                for step in (0, 1):
                    who, sig, band, kind, slack = signatures(owner, shingle, size, step)
                    if len(who):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(signed(sig)), pa.array(key[who]), *(pa.array(x.astype(np.int32)) for x in (band, kind, slack))],
                            names=["sig", "key", "band", "kind", "slack"])
    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature, key and kind: those whose signature has several keys, once
    each, with the length of the list (as far as it was read, if that is over a batch limit)."""
    held: list[pa.RecordBatch] = []
    before = (None, None, False, 0)  # of a list passed on in part: signature, first key, whether shared, rows

    def emit(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        nonlocal before
        sig, key, kind = (rows[c].to_numpy() for c in ("sig", "key", "kind"))
        head = np.append(True, sig[1:] != sig[:-1])
        once = head | np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], len(sig))
        count = np.add.reduceat(once, begin)
        several = key[begin] != key[end - 1]
        if sig[0] == before[0]:
            several[0] |= before[2] or key[0] != before[1]
            count[0] += before[3]
        long_tail = not last and len(sig) - begin[-1] >= HELD_ROWS
        if long_tail:
            at = begin[-1]
            first_key = before[1] if sig[0] == before[0] and at == 0 else key[at]
            before = (sig[-1], first_key, bool(several[-1]), int(count[-1]))
            several[-1] = True
        upto = len(sig) if last or long_tail else begin[-1]
        group = np.cumsum(head) - 1
        keep = several[group] & once
        keep[upto:] = False
        listed = pa.array(count[group].astype(np.int32))
        return rows.append_column("listed", listed).filter(pa.array(keep)), rows.slice(upto)

    for batch in batches:
        if batch.num_rows:
            out, rest = emit(pa.Table.from_batches([*held, batch]), False)
            held = rest.combine_chunks().to_batches()
            yield from out.combine_chunks().to_batches()
    if held:
        yield from emit(pa.Table.from_batches(held), True)[0].combine_chunks().to_batches()


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The pairs of classes ``(a, b)`` whose sets link."""
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    first = members.groupBy("key").agg(F.min("doc").alias("doc")).join(needed, "key", "left_semi")
    sets = written(docs.join(first, "doc").select("key", "text").mapInArrow(_set_rows(n), "key long, shingles binary")
                   .dropDuplicates(["key"]), "sets")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_overlap, "a long, b long"), "links")
    dropped(sets)
    return out


def _may_link(one: str, other: str) -> Column:
    """Whether the bitmaps differ in no more bits than linked sets of these sizes may differ."""
    apart = sum((F.bit_count(F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{other}.{c}"))) for c in SKETCH), F.lit(0))
    allowed = (F.col(f"{one}.size") + F.col(f"{other}.size")) * (100 - PERCENT) / (100 + PERCENT)
    return apart <= allowed


def _probing(lists: DataFrame) -> DataFrame:
    """Adds whether a set probes the list: it passes over its longest ones within its slack."""
    longest = (Window.partitionBy("key", "band").orderBy(F.desc("listed"), "sig")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = F.sum(F.when(F.col("kind") == EXACT, 1).otherwise(0)).over(longest)
    return lists.withColumn("probes", (F.col("kind") != EXACT) | (passed > F.col("slack")))


def link_classes(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Components of classes: ``(node, root)`` for each class that links with another."""
    classes = members.dropDuplicates(["key"]).select("key", "size", *SKETCH)
    signed_rows = docs.select("text").mapInArrow(_signature_rows(n), SIGNATURES)
    lists = written(signed_rows.repartition("sig").sortWithinPartitions("sig", "key", "kind")
                    .mapInArrow(_shared_rows, SIGNATURES + ", listed int"), "lists")
    probing = _probing(lists)
    each = Window.partitionBy("sig")
    open_lists = written(
        probing.withColumn("hub", F.min("key").over(each)).withColumn("probed", F.max("probes").over(each))
        .filter("probed").select("sig", "key", "kind", "probes", "hub").distinct(), "open-lists")
    dropped(lists)
    hubs = open_lists.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    hubs = written(hubs.join(classes.alias("one"), F.col("a") == F.col("one.key"))
                   .join(classes.alias("other"), F.col("b") == F.col("other.key"))
                   .filter(_may_link("one", "other")).select("a", "b"), "hubs")
    links, tested = verified(hubs, docs, members, n), hubs
    for share in LIST_SHARES:
        parts = written(components(links), "parts")
        late = _between_parts(open_lists.filter(F.pmod("sig", F.lit(share)) == 0), parts, classes, tested)
        links = links.union(verified(late, docs, members, n))
        tested = tested.union(late)
    return written(components(links), "parts")


def _between_parts(lists: DataFrame, parts: DataFrame, classes: DataFrame, tested: DataFrame) -> DataFrame:
    """Untested pairs that meet in a list, that may link, and that are not in one component yet."""
    placed = (lists.join(parts.withColumnRenamed("node", "key"), "key", "left")
              .withColumn("part", F.coalesce("root", "key")).drop("root"))
    mixed = placed.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    unsettled = written(placed.join(mixed, "sig", "left_semi").join(classes, "key"), "unsettled")
    one, other = unsettled.filter("probes").alias("one"), unsettled.alias("other")
    pairs = written(
        one.join(other, F.col("one.sig") == F.col("other.sig"))
        .filter("one.part <> other.part and not (one.kind = 2 and other.kind = 2)").filter(_may_link("one", "other"))
        .select(F.least("one.key", "other.key").alias("a"), F.greatest("one.key", "other.key").alias("b")).distinct(), "pairs")
    rest = written(pairs.join(tested, ["a", "b"], "left_anti"), "rest")
    dropped(unsettled, pairs)
    return rest


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """Rows ``(id, n_shingles, component_id)``, one per input row."""
    rows = only(docs, doc=id_col, text=text_col)
    rows = rows.withColumn("doc", F.coalesce(F.col("doc").cast("long"), F.lit(NULL_ID)))
    members = written(rows.mapInArrow(_size_rows(n), "doc long, size long, key long, " + ", ".join(f"{c} long" for c in SKETCH)),
                      "members")
    parts = link_classes(rows, members.filter("size > 0"), n)
    placed = (members.select("doc", "size", "key").join(parts.withColumnRenamed("node", "key"), "key", "left")
              .withColumn("part", F.coalesce("root", "key")))
    lowest = (placed.filter("size > 0").groupBy("part").agg(F.min("doc").alias("lowest"), F.count("*").alias("n"))
              .filter("n > 1").drop("n"))
    alone = F.when(F.col("size") > 0, F.col("lowest"))
    return (placed.join(lowest, "part", "left")
            .select(F.nullif("doc", F.lit(NULL_ID)).alias(id_col), F.col("size").alias("n_shingles"),
                    F.nullif(F.coalesce(alone, "doc"), F.lit(NULL_ID)).alias("component_id")))
