"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

from feedpulse.llm.decontaminate import decontaminate, matches

from .conftest import ODD_ROWS, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size=10):
    out = []
    for d, text in rows:
        w, hit, found = split(text), set(), set()
        for item, item_text in items:
            v = split(item_text)
            n = min(size, len(v))
            windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if windows else ():
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def make(seed):
    r = random.Random(str(seed))
    items = [(k, " ".join(words((seed, k), r.choice([1, 4, 9, 10, 11, 25]), 60))) for k in range(12)]
    items += [(90, None), (91, ""), (92, "..."), (3, items[3][1]), (None, items[5][1])]
    rows = []
    for i in range(30):
        text = []
        for _ in range(r.randrange(0, 4)):
            text += words(r.random(), r.randrange(0, 25), 60)
            v = (r.choice(items)[1] or "").split()
            text += v[r.randrange(0, 3):]
        rows.append((i, r.choice([" ", ", ", "-"]).join(text).replace("w", r.choice("wW"))))
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, frame, seed):
    rows, items = make(seed)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS block", "3 AS bucket")
    got = [tuple(r) for r in decontaminate(frame(rows + ODD_ROWS), bench).collect()]
    named = [(i, t) for i, t in items if i is not None]
    want = brute(rows + ODD_ROWS, named)
    # an item without id counts its hits, but has no name
    unnamed = brute(rows + ODD_ROWS, items)
    assert sorted((g[:3] for g in got), key=str) == sorted((u[:3] for u in unnamed), key=str)
    assert sorted(((g[0], g[1], g[3], g[4]) for g in got), key=str) == sorted(((u[0], u[1], u[3], u[4]) for u in want), key=str)


def test_empty_sides(spark, frame):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(frame([]), bench).collect() == []
    got = decontaminate(frame([(1, "a b c d")]), bench.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(4, 0, False)]


def test_proximity_matches(spark, frame):
    bench = spark.createDataFrame([(1, "red green blue black white")], "item_id long, text string")
    rows = [(1, "red green blue black white"), (2, "red green very blue black white"), (3, "white x x x x x x x red green blue black")]
    _, hits = matches(frame(rows), bench, size=5, slop=2)
    assert {r["doc_id"] for r in hits.filter("exact").collect()} == {1}
    assert {r["doc_id"] for r in hits.filter("not exact").collect()} == {1, 2}
