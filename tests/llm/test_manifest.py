"""Merkle manifest against a plain tree, and the closed form against the log itself."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from feedpulse.llm import manifest as M

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(nodes):
    """Root, and for each leaf its [(left, right)] siblings, level by level."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i:i + 16]
            for k, mine in enumerate(owners[i:i + 16]):
                for x in mine:
                    proofs[x].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            up_owners.append([x for mine in owners[i:i + 16] for x in mine])
        nodes, owners = up, up_owners
    return (nodes or [None])[0], proofs


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in order:
        mine = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        parts.append((mine, *tree([leaf(r, r.text) for r in mine])))
    root, tops = tree([p[1] for p in parts])
    out = []
    for (mine, subroot, proofs), top in zip(parts, tops):
        for r, proof in zip(mine, proofs):
            steps = proof + top
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            digest = leaf(r, "".join(c.lower() if c.isascii() else c for c in r.text) if bad else r.text)
            for a, b in steps:
                digest = h(a, digest, b)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, h(*[a + b for a, b in steps]), digest, digest == root))
    return sorted(out, key=repr)


def checked(df):
    lowered = M.leaf_digest(*[F.translate(c, M.UPPER, M.LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    held = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered).otherwise(M.leaf_digest(*map(F.col, COLUMNS)))
    return sorted(map(tuple, M.manifest(df, COLUMNS, held=held).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    out = [(i, r.choice(["a", "b", None, "", "é"]), r.choice(["en", None]), i % 7 or None, r.choice(["Text A", "x", None, "", "ÄÖ Z"])) for i in range(150)]
    out += [(1000 + i, "hot", "en", i, f"Body {i}") for i in range(700)]
    out += [(5, "a", "en", 1, "Same"), (5, "a", "en", 1, "Same"), (5, "a", "en", 1, "Other"), (None, "a", "en", 1, "None"), (None, "b", None, None, None),
            (9999, "alone", "en", 3, "AbC" * 50000)]
    return [(*x, "p", "q", "t") for x in out]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx string, tree string, total string"


def test_against_plain_tree(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert checked(df.repartition(5)) == brute(df.collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_many_builders(spark, rows, monkeypatch, levels):
    """Small builders, so that trees take several rounds of them."""
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "SPAN", M.FAN ** levels)
    many = rows + [(20000 + i, f"s{i:03}", "en", i, "Own source", "p", "q", "t") for i in range(300)]
    df = spark.createDataFrame(many, SCHEMA)
    assert checked(df) == brute(df.collect())


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 272, 273, 300, 4095, 4096])
def test_closed_form(n):
    """Each node's place in the log, by digest, for the tree's own height and one builder's."""
    for height in {M.height_of(n), M.LEVELS}:
        if 16 ** height < n:
            continue
        leaves = [i.to_bytes(32, "big") for i in range(n)]
        log = M.append_log(leaves, height)
        level, nodes, places = 0, leaves, []
        while True:
            at = M.log_position(level, list(range(len(nodes))), n, height)
            assert [log[a] for a in at] == nodes
            places += list(at)
            if level == height:
                break
            nodes = [M._combined(nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
            level += 1
        assert sorted(places) == list(range(len(log)))


def test_one_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "T")], SCHEMA.rsplit(", ", 3)[0])
    assert checked(df) == brute(df.collect())
    assert checked(df.filter("false")) == []
