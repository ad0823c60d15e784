"""The trigram index against the scan."""

import glob
import os
import pathlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from feedpulse.operators import textindex
from feedpulse.operators.textindex import TextIndex, query_grams
from feedpulse.session import checkpoint_dir


def texts(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gam-ma", "ÄÖÜ", "straße", "😀go", "needle", "x", "\n", "the"]
    rows = [(i, rng.choice([None, "", "ab"]) if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randrange(1, 9))))
            for i in range(n)]
    rows += [(5, "twin row"), (5, "twin row"), (n, "common " * 4000 + "Rarity")]
    return spark.createDataFrame(rows, "id long, text string").repartition(5)


def scan(df, *terms):
    return sorted(r.id for r in df.where(" or ".join(f"contains(lower(text), '{t.lower()}')" for t in terms)).collect())


def test_search_equals_scan(spark):
    df = texts(spark, 300)
    index = TextIndex(spark, df.schema, block_rows=16).add(df)
    for query in ["beta gam", "the", "ÄÖÜ", "😀go", "x", "twin row", "rarity", "absent", "a \n x"]:
        assert sorted(r.id for r in index.matching(query).collect()) == scan(df, query), query
    assert sorted(r.id for r in index.matching_any(["needle", "twin", "absent"]).collect()) == scan(df, "needle", "twin", "absent")
    assert index.matching("needle").columns == df.columns
    with pytest.raises(ValueError):
        index.matching("")


def test_only_blocks_with_candidates_are_read(spark):
    df = texts(spark, 300)
    index = TextIndex(spark, df.schema, block_rows=16).add(df)
    found = index.matching("rarity")
    rarest = index.rarest("rarity")
    assert rarest[0][1] == 1 and index.candidates(rarest).count() == 1
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    # every other block is made unreadable, and the search doesn't notice
    block = index.candidates(rarest).first()["__block"]
    spoilt = 0
    for file in glob.glob(f"{index.path}/rows/*/*/*.parquet"):
        if f"__block={block}/" not in file:
            pathlib.Path(file).write_bytes(b"spoilt")
            pathlib.Path(file).with_name(f".{os.path.basename(file)}.crc").unlink()
            spoilt += 1
    assert spoilt > 10 and [r.id for r in found.collect()] == [300]


def test_runs_are_added_and_repeated(spark):
    path = f"{checkpoint_dir(spark)}/textindex-test/{uuid.uuid4().hex[:8]}"
    first, second = texts(spark, 100), texts(spark, 150, seed=2)
    index = TextIndex(spark, first.schema, path=path, block_rows=32).add(first, "d1")
    index.add(second, "d2").add(second, "d2")
    both = first.union(second)
    again = TextIndex(spark, first.schema, path=path)
    for query in ["needle", "the", "rarity", "zz"]:
        assert sorted(r.id for r in again.matching(query).collect()) == scan(both, query)
    again.add(first.limit(0), "d3")
    assert sorted(r.id for r in again.matching("beta").collect()) == scan(both, "beta")
    with pytest.raises(ValueError):
        index.add(first, "a/b")
    with pytest.raises(ValueError):
        index.add(first.withColumn("run", F.lit(1)), "d4")


def test_empty_index_and_hot_trigram(spark):
    none = TextIndex(spark, texts(spark, 0).schema).add(texts(spark, 1).limit(0))
    assert none.matching("the").count() == 0 and none.matching("a").count() == 0
    # a trigram of all rows: its lists end with their blocks
    df = spark.range(3000).select("id", F.concat(F.lit("same start "), F.col("id")).alias("text"))
    index = TextIndex(spark, df.schema, block_rows=250).add(df)
    assert index._postings().where(F.col("gram") == query_grams("sam")[0]).agg(F.max(F.size("places"))).first()[0] <= 250
    assert sorted(r.id for r in index.matching("start 29").collect()) == scan(df, "start 29")


def test_a_block_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(textindex, "GATHERED", 50)
    df = texts(spark, 60)
    index = TextIndex(spark, df.schema).add(df)
    for query in ["beta gam", "twin row"]:
        assert sorted(r.id for r in index.matching(query).collect()) == scan(df, query)


def test_query_grams():
    assert len(query_grams("abcabc")) == 3 and query_grams("ab") == query_grams("") == []
    assert query_grams("a😀\U0010ffff")[0] == 97 | 0x1F600 << 21 | 0x10FFFF << 42


def test_searches_over_the_index(spark):
    rows = [(f"@c{i % 3}", i, None if i % 11 == 0 else f"message {i} about {'Needles' if i % 7 == 0 else 'hay'} here") for i in range(200)]
    messages = spark.createDataFrame(rows, "channel string, message_id long, text string").withColumn(
        "date", F.timestamp_seconds(F.col("message_id") + 1_700_000_000)).withColumn("views", F.lit(1)).withColumn("forwards", F.lit(0))
    index = TextIndex(spark, messages.schema, block_rows=16).add(messages)
    hits = index.matching("needle")
    assert sorted(r.message_id for r in hits.collect()) == [i for i in range(200) if i % 7 == 0 and i % 11]


def test_lists_are_built_from_at_most_a_million_entries():
    import pyarrow as pa
    from feedpulse.operators.textindex import _parts, grams
    low = "".join(chr(0x4E00 + i) for i in range(16_000))
    batch = pa.RecordBatch.from_pydict({"block": ["0-0"] * 200, "at": pa.array(range(200), pa.int32()), "low": [low, None] * 100})
    out = list(_parts(iter([batch])))
    entries = [len(b.column(2).flatten()) for b in out]
    assert sum(entries) == 100 * len(grams(low)) and max(entries) <= (1 << 20) + len(grams(low))
