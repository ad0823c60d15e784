"""Many keywords at once, as substrings (J6, X2, X6 for large vocabularies).

``functions.mentions.keyword_hit`` is a chain of one substring test per keyword, right for a few dozen. Here the
keywords are a table:

* up to ``MAX_KEY_BYTES`` they are broadcast by their checked bytes, and each task builds one Aho-Corasick automaton, which
  finds all keywords, nested and overlapping ones too, in one pass over a text. Nothing is shuffled, and a worker passes
  its rows on after every ``PIECE`` of them, however many keywords its texts have;
* beyond it, each keyword is looked for by its seed, its first ``k`` characters with the largest ``k`` of
  ``SEEDS`` that it has. The texts' seeds pass a bit set of fixed size in the scan, meet the keywords in a join by seed,
  and the pairs are compared with the text itself.

Both give the same rows. Keywords and texts are compared in lower case, as Spark lower-cases them.

Defined cases: a null or empty text has no keyword; null and empty keywords name nothing and are left out; an empty vocabulary
gives no rows; repeated keywords count once; each input row gives its own pairs, also where ids repeat.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import written_table
from .reduction import MAX_KEY_BYTES, may_match

SEEDS = (1, 2, 3, 4, 6, 8, 12, 24, 48)

#: Rows after which a worker passes on what it has.
PIECE = 1 << 16


def _matcher(vocabulary):
    """Over batches ``(id, lower-cased text)``; ``vocabulary`` broadcasts ``{keyword: labels}``."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        machine = ahocorasick.Automaton()
        names = sorted({label for labels in vocabulary.value.values() for label in labels})
        number = {label: i for i, label in enumerate(names)}
        labels_of = []  # by keyword; the automaton holds a keyword's place in it
        for keyword, labels in vocabulary.value.items():
            machine.add_word(keyword, len(labels_of))
            labels_of.append(tuple(number[label] for label in labels))
        machine.make_automaton()
        names = pa.array(names, pa.string())

        def piece(batch: pa.RecordBatch, rows: array, found: array) -> pa.RecordBatch:
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, names.take(pa.array(found, pa.int64()))],
                                              names=[batch.schema.names[0], "label"])

        for batch in batches:
            rows, found = array("q"), array("q")
            for i, text in enumerate(batch.column(1)):
                hits = {k for _, k in machine.iter(text.as_py())} if text.is_valid else ()
                labels = sorted({label for k in hits for label in labels_of[k]})
                rows.extend(array("q", [i]) * len(labels))
                found.extend(labels)
                if len(rows) >= PIECE:
                    yield piece(batch, rows, found)
                    rows, found = array("q"), array("q")
            if rows:
                yield piece(batch, rows, found)
    return match


def _by_automaton(texts: DataFrame, words: DataFrame, id_col: str) -> DataFrame:
    per_word = words.groupBy("keyword").agg(F.collect_set("label").alias("labels")).collect()
    vocabulary = texts.sparkSession.sparkContext.broadcast({r.keyword: tuple(r.labels) for r in per_word})
    schema = StructType([texts.schema[id_col], StructField("label", StringType())])
    return texts.mapInArrow(_matcher(vocabulary), schema)


def _by_seeds(texts: DataFrame, words: DataFrame, id_col: str) -> DataFrame:
    length = F.array_max(F.filter(F.array(*map(F.lit, SEEDS)), lambda k: k <= F.length("keyword")))
    words = words.withColumn("k", length).withColumn("seed", F.substring("keyword", F.lit(1), F.col("k")))
    sizes = sorted(r.k for r in words.select("k").distinct().collect())  # at most len(SEEDS) rows
    texts = written_table(texts.withColumn("__n", F.monotonically_increasing_id()), "texts")
    runs = [F.regexp_extract_all("__low", F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in sizes]
    seeds = texts.select("__n", F.explode(F.array_distinct(F.concat(*runs))).alias("seed"))
    pairs = may_match(seeds, words, "seed").join(words, "seed").select("__n", "keyword", "label")
    hits = texts.join(pairs, "__n").where(F.col("__low").contains(F.col("keyword")))
    return hits.select("__n", id_col, "label").distinct().select(id_col, "label")


def keyword_rows(df: DataFrame, vocabulary: DataFrame, id_col: str = "id", text_col: str = "text",
                 keyword_col: str = "keyword", label_col: str | None = None,
                 max_bytes: int = MAX_KEY_BYTES) -> DataFrame:
    """Rows ``(id, label)``: the labels of the keywords that a row's text contains, each once a row. Without
    ``label_col`` a keyword is its own label, in lower case."""
    keyword = F.lower(F.col(keyword_col).cast("string"))
    label = F.col(label_col).cast("string") if label_col else keyword
    words = written_table(vocabulary.select(keyword.alias("keyword"), label.alias("label"))
                          .where("keyword <> '' and label is not null").distinct(), "keywords")
    size = words.agg(F.sum(F.octet_length("keyword") + F.octet_length("label") + 16)).first()[0]
    texts = df.select(F.col(id_col), F.lower(F.col(text_col)).alias("__low"))
    if not size:
        return texts.where(F.lit(False)).select(id_col, F.lit("").alias("label"))
    return (_by_automaton if size <= max_bytes else _by_seeds)(texts, words, id_col)


def keyword_vocabulary(spark, terms: dict[str, list[str]]) -> DataFrame:
    """A vocabulary table ``(keyword, label)`` from labels with their keywords."""
    return spark.createDataFrame([(k, label) for label, ks in terms.items() for k in ks], "keyword string, label string")
