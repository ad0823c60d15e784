"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re

import pytest

from feedpulse.llm import jaccard_join as J
from feedpulse.llm.common import components
from feedpulse.llm.exact_dedup import exact_dedup
from feedpulse.llm.jaccard_join import jaccard_components
from feedpulse.llm.substring_dedup import remove_repeats

from .conftest import ODD_ROWS, words

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_rows(seed, groups=12, vocabulary=400):
    """Random texts with edited copies around the similarity limit, short ones among them."""
    r = random.Random(str(seed))
    rows, n = [], 0
    for g in range(groups):
        base = words((seed, g), r.choice([3, 6, 9, 14, 30, 80, 200]), vocabulary)
        for _ in range(r.randrange(1, 7)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25 + 2))):
                at = r.randrange(len(copy))
                copy[at:at + r.randrange(0, 2)] = words(r.random(), r.randrange(0, 2), vocabulary)
                copy = copy or ["x"]
            rows.append((n, " ".join(copy)))
            n += r.randrange(1, 4)
    r.shuffle(rows)
    return rows


def brute_components(rows, n=5):
    sets = []
    for _, text in rows:
        w = split(ascii_lower(text))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = [i if i is not None else float("inf") for i, _ in rows]
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), float("inf")), ids[i])
    return sorted(((d, len(sets[i]), None if low[find(i)] == float("inf") else low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components_match_brute_force(frame, seed):
    rows = near_rows(seed)
    got = [tuple(r) for r in jaccard_components(frame(rows)).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_jaccard_odd_rows(frame):
    got = [tuple(r) for r in jaccard_components(frame(ODD_ROWS)).collect()]
    assert sorted(got, key=str) == brute_components(ODD_ROWS)


def test_jaccard_common_passage_and_large_near_group(frame):
    passage = words("p", 60, 900)
    rows = [(i, " ".join(words(i, 40, 900) + passage)) for i in range(60)]
    base = words("base", 120, 900)
    for i in range(60, 120):
        copy = list(base)
        copy[i % 120] = f"own{i}"
        rows.append((i, " ".join(copy)))
    got = [tuple(r) for r in jaccard_components(frame(rows)).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_jaccard_every_band_covers_its_differences():
    """Partners are in neighbouring bands, and segments outnumber the differences allowed."""
    tops = J.band_tops()
    for size in range(1, 3000):
        band = next(b for b, top in enumerate(tops) if top >= size)
        assert size * 100 // J.PERCENT <= tops[band + 1]
    for band in range(40):
        segments, deletions = J.allocation(band)
        assert segments + deletions >= J.differences(2 * tops[band]) + 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def union_find(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def small_graph(seed):
    """A path, or a random graph, of few nodes with shuffled ids."""
    r = random.Random(str(seed))
    ids = r.sample(range(1, 100), r.choice([5, 6, 8]))
    edges = list(zip(ids, ids[1:])) if r.random() < .7 else [r.sample(ids, 2) for _ in ids]
    return [tuple(r.sample(e, 2)) for e in edges]


@pytest.mark.parametrize("edges", [[(3, 1), (4, 3), (5, 4), (5, 2)], *map(small_graph, range(6))], ids=str)
def test_components_of_small_graphs_match_union_find(spark, edges):
    # one graph a call: among others, another one that isn't settled would hide an early stop
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted(union_find(edges).items())


def test_exact_dedup_odd_rows(frame):
    norm = [(d, BLANK.sub(" ", t or "")) for d, t in ODD_ROWS]
    for digest in (False, True):
        got = exact_dedup(frame(ODD_ROWS), digest=digest).collect()
        assert len(got) == len(ODD_ROWS)
    want = []
    for d, t in norm:
        same = [x for x, u in norm if u == t]
        keep = min((x for x in same if x is not None), default=d)
        want.append((d, keep, len(same), keep == d if d is not None else None, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_exact_dedup_without_digest_agrees(frame, table):
    docs = table("documents")
    with_digest = exact_dedup(docs, digest=True).drop("text_sha256")
    assert sorted(exact_dedup(docs).collect()) == sorted(with_digest.collect())


def brute_removed(rows, size=13):
    split_rows = [(float("inf") if d is None else d, split(t)) for d, t in rows]
    first = {}
    for d, w in split_rows:
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for (given, _), (d, w) in zip(rows, split_rows):
        gone = {k for i in range(len(w) - size + 1) if first[tuple(w[i:i + size])] < d for k in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((given, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passage_rows(seed):
    r = random.Random(str(seed))
    passages = [words((seed, k), r.randrange(10, 60), 30) for k in range(6)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(r.randrange(0, 5)):
            text += words(r.random(), r.randrange(0, 20), r.choice([3, 500]))
            p = r.choice(passages)
            text += p[r.randrange(0, 5):len(p) - r.randrange(0, 5)]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(text)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_removal_matches_brute_force(frame, seed):
    rows = passage_rows(seed)
    got = [tuple(r) for r in remove_repeats(frame(rows), with_text=False).collect()]
    assert sorted(got, key=str) == brute_removed(rows)


def test_substring_windows_equal_in_32_bits_are_kept(frame):
    # windows around one anchor whose 64-bit hashes agree in 31 of the upper 32 bits
    tail = " p127 p382 p82 p401 p177 p561"
    rows = [(1, "w204 w470 w747 w183 w723 w957 w630" + tail), (2, "w947 w175 w598 w256 w157 w850 w553" + tail),
            (3, "w846 w368 w453 w862 w211 w285 w830" + tail), (4, "w382 w401 w343 w675 w911 w727 w13" + tail)]
    got = [tuple(r) for r in remove_repeats(frame(rows), with_text=False).collect()]
    assert sorted(got, key=str) == brute_removed(rows)


def test_substring_odd_rows_and_kept_text(frame):
    rows = ODD_ROWS + [(20, dict(ODD_ROWS)[7] + " tail"), (None, "a " * 400)]
    got = remove_repeats(frame(rows)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_removed(rows)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("run", [exact_dedup, jaccard_components, remove_repeats])
def test_empty_table(frame, run):
    assert run(frame([])).collect() == []
