"""Keyword tables against one substring test per keyword."""

import random

import pytest
from pyspark.sql import functions as F

from feedpulse.functions import mentions as M
from feedpulse.operators.keywords import SEEDS, keyword_rows, keyword_vocabulary

TEXTS = [(1, "The paper tape"), (2, None), (3, ""), (4, "AAAA"), (5, "ÄPFEL 😀go straße\nend"), (5, "the end"), (5, "the end"),
         (None, "ape"), (7, "x" * 60 + "y")]
WORDS = ["ape", "paper", "PAPER", "tape", "a", "aa", "aaa", "aaaaa", "äpfel", "😀", "😀go", "straße\ne", "the", "absent", "x" * 60,
         "x" * 59 + "y", "x" * 61, None, ""]


def brute(rows, words):
    words = {w.lower() for w in words if w}
    return sorted((i or 0, w) for i, t in rows if t for w in words if w in t.lower())


@pytest.mark.parametrize("max_bytes", [1 << 24, 0])
def test_equals_substring_tests(spark, max_bytes):
    df = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS], "id long, text string, label string")
    words = spark.createDataFrame([(w,) for w in WORDS], "keyword string")
    out = keyword_rows(df, words, max_bytes=max_bytes)
    assert out.columns == ["id", "label"]
    assert sorted((r.id or 0, r.label) for r in out.collect()) == brute(TEXTS, WORDS)
    assert keyword_rows(df, words.limit(0), max_bytes=max_bytes).count() == 0
    assert keyword_rows(df.limit(0), words, max_bytes=max_bytes).count() == 0


@pytest.mark.parametrize("max_bytes", [1 << 24, 0])
def test_labels_and_random_words(spark, max_bytes):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abc", k=n))
    rows = [(i, word(rng.randrange(0, 120))) for i in range(200)] + [(900 + i, "common start " + word(5)) for i in range(100)]
    terms = {f"s{j}": [word(rng.choice(SEEDS[:7]) + rng.randrange(2)) for _ in range(3)] + ["common start"] * (j == 3) for j in range(60)}
    df = spark.createDataFrame(rows, "id long, text string")
    out = keyword_rows(df, keyword_vocabulary(spark, terms), label_col="label", max_bytes=max_bytes)
    want = sorted((i, s) for i, t in rows for s, ks in terms.items() if any(k in t for k in ks))
    assert sorted(map(tuple, out.collect())) == want


def test_a_hundred_thousand_keywords_in_one_pass(spark):
    words = spark.range(100_000).select(F.concat(F.lit("key"), F.col("id"), F.lit(";")).alias("keyword"))
    df = spark.range(2000).select("id", F.concat(F.lit("some KEY"), F.col("id") * 7, F.lit("; key1; end")).alias("text"))
    out = keyword_rows(df, words)
    got = out.groupBy("id").agg(F.count("*").alias("n"), F.max("label").alias("last")).collect()
    assert len(got) == 2000 and all(r.n == 2 for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_equals_the_or_chain(spark):
    keywords = ["able", "sich", "pour", "para", "th"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    words = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    n = keyword_rows(docs, words).groupBy("id").count()
    want = docs.select("id", M.keyword_count("text", keywords).alias("n")).where("n > 0")
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, want.collect()))


def test_rows_are_passed_on_in_bounded_pieces(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa
    from feedpulse.operators import keywords as K
    monkeypatch.setattr(K, "PIECE", 500, raising=False)
    words = [f"w{i};" for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "__low": ["".join(words), None] * 20})
    out = list(K._matcher(SimpleNamespace(value={w: (w,) for w in words}))(iter([batch])))
    assert len(out) == 4 and max(b.num_rows for b in out) <= 600
    rows = [r for b in out for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert rows == [(i, w) for i in range(0, 40, 2) for w in sorted(words)]
