"""Source divergence against plain Python, with collisions forced by short digests."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from feedpulse.llm import divergence as D


def brute(rows, min_docs, top):
    by_group, docs_of, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        by_group[lang, source].update(terms)
        langs[lang].add(source)
        docs_of[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs_of[lang].items() if n >= min_docs]
        total = {s: sum(by_group[lang, s][t] for t in kept) for s in sources}
        every, v = sum(total.values()), len(kept)
        p = {s: {t: 1 + D.SCALE * (by_group[lang, s][t] + 1) // (total[s] + v) for t in kept} for s in sources}
        q = {t: 1 + D.SCALE * (sum(by_group[lang, s][t] for s in sources) + 1) // (every + v) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if by_group[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, math.inf), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if rank <= most:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "aBéß" for b in "xyz漢" for c in ("", "q", "Ünï", " ")]
    return [" ".join(r.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=r.randrange(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None]), t) for t in texts(1, 120)]
    out += [("en", "hot", "a1b2c-d e_f\tG.H" * 3)] * 40  # one group holds a third of the rows
    out += [("fr", "alone", "un deux trois"), ("fr", "alone", "un deux"), ("fr", "alone", "un"), ("es", "none", None), ("es", "other", "12 ?")]
    return out + [("en", "s1", " ".join(["long", "words"] * 20000))]


@pytest.mark.parametrize("bits,part_bytes", [(64, D.PART_BYTES), (3, D.PART_BYTES), (3, 200), (5, 1)])
def test_against_brute_force(spark, rows, bits, part_bytes):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "lang string, source string, text string, digest string, place string")
    got = D.divergence(df.repartition(3), top=7, digest_bits=bits, part_bytes=part_bytes).collect()
    assert sorted(map(tuple, got)) == brute(rows, D.MIN_DOCS, 7)


def test_tiles_and_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "TILE", 2)
    monkeypatch.setattr(D, "BUCKET", 10)
    monkeypatch.setattr(D, "CELLS", 8)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, D.divergence(df, top=7).collect())) == brute(rows, D.MIN_DOCS, 7)


def test_shares_beyond_64_bits(spark):
    n = 2_000_000_000_000
    got = spark.range(1).select(D.share(D.F.lit(n), D.F.lit(5 * n), D.F.lit(7))).first()[0]
    assert got == 1 + D.SCALE * (n + 1) // (5 * n + 7)


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
