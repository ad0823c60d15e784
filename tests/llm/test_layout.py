"""Sharding and packing: the laws their results obey."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from feedpulse.llm.packing import Bins, pack
from feedpulse.llm.sharding import longest_first, shard

from .conftest import ODD_ROWS, words


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    at = {}
    for r in got:
        assert at.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]


def test_shard_odd_rows(frame):
    check_shards(ODD_ROWS, shard(frame(ODD_ROWS)).collect(), 8)


def test_shards_are_even_and_keep_copies_together(frame):
    r = random.Random(5)
    rows = [(i, " ".join(words(i, r.randrange(1, 60), 5000))) for i in range(600)]
    rows += [(1000 + i, "the same text again") for i in range(300)]
    got = shard(frame(rows), cells=64).collect()
    check_shards(rows, got, 8)
    load = Counter()
    for row in got:
        load[row["shard"]] += row["size"]
    assert max(load.values()) - min(load.values()) <= 0.03 * sum(load.values())


def test_longest_first_is_the_textbook_rule():
    sizes = [(7, 0), (7, 1), (6, 2), (6, 3), (5, 4), (4, 5), (4, 6)]
    at = longest_first(sizes, 3)
    load = Counter()
    for size, item in sizes:
        load[at[item]] += size
    assert [load[s] for s in range(3)] == [12, 15, 12]


def check_packing(rows, got, capacity):
    by_doc = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["part"], r["bin"]].append(r)
    lengths = defaultdict(int)
    for d, t, _ in rows:
        lengths[d] += len((t or "").split()) + 1
    assert {d: sum(p["length"] for p in ps) for d, ps in by_doc.items()} == dict(lengths)
    for pieces in bins.values():
        pieces.sort(key=lambda p: p["offset"])
        end = 0
        for p in pieces:
            assert p["offset"] == end
            end += p["length"]
        assert end <= capacity
    return bins


def test_packing_holds_everything_and_no_conflict(spark):
    r = random.Random(3)
    rows = [(i, " ".join(words(i, r.choice([1, 5, 20, 90, 250]), 9000)), r.choice(["hot", "hot", "a", "b", "c", "d", None]))
            for i in range(400)]
    rows += [(1000 + i, "copy of one text", f"u{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS length", "2 AS bin", "3 AS rest")
    bins = check_packing(rows, pack(docs, capacity=100, part_rows=150).collect(), 100)
    source, text = {d: s for d, _, s in rows}, {d: t for d, t, _ in rows}
    for pieces in bins.values():
        sources = [source[p["doc_id"]] for p in pieces if source[p["doc_id"]]]
        assert len(sources) == len(set(sources))
        texts = [text[p["doc_id"]] for p in pieces]
        assert len(texts) == len(set(texts))


def test_best_fit_is_the_tightest_compatible_bin():
    r = random.Random(9)
    items = sorted(((r.randrange(1, 50), 1 << r.randrange(5), r.choice([0, 0, 1, 2])) for _ in range(400)), reverse=True)
    bins, plain = Bins(60), []
    for length, source, cluster in items:
        number, offset = bins.place(length, source, cluster)
        fits = [b for b in plain if b[0] >= length and not b[1] & source and not b[2] & cluster]
        tightest = min((b[0] for b in fits), default=60)
        if number == len(plain):
            assert not fits
            plain.append([60, 0, 0])
        assert plain[number][0] == tightest and offset == 60 - tightest
        plain[number][0] -= length
        plain[number][1] |= source
        plain[number][2] |= cluster


def test_packing_odd_rows(frame):
    got = pack(frame(ODD_ROWS), capacity=2048).collect()
    check_packing([(d, t, None) for d, t in ODD_ROWS if "\u00a0" not in (t or "")],
                  [r for r in got if r["doc_id"] != 6], 2048)


@pytest.mark.parametrize("run", [shard, pack])
def test_empty_table(frame, run):
    assert run(frame([])).collect() == []
