"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination,
best-fit packing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents`` for the rows they keep:

* language ID: rows whose text is in none of the wanted languages go;
* exact dedup: of equal texts the row with the smallest id stays;
* Jaccard join: of each component of linked documents the one with the smallest id stays;
* decontamination: documents with an exact benchmark phrase go;
* packing: what is left, as pieces in sequences.

Rows that repeat an id are one document: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedpulse.llm.common import written
from feedpulse.llm.decontaminate import decontaminate
from feedpulse.llm.exact_dedup import exact_dedup
from feedpulse.llm.jaccard_join import jaccard_components
from feedpulse.llm.language import identify
from feedpulse.llm.packing import pack
from feedpulse.llm.queries import read

#: The columns that hold evidence: the declared language and, as host, the source.
ID, TEXT = "doc_id", "text"


def _without(docs: DataFrame, judged: DataFrame, kept: Column) -> DataFrame:
    """The rows of ``docs`` but for ids that no judged row keeps.

    The ids that go are the smaller side; as a table of known size they are broadcast while
    they are small, and then no text is shuffled.
    """
    gone = judged.groupBy(F.col(ID).alias("gone_id")).agg(F.max(kept).alias("kept")).filter("not kept").select("gone_id")
    gone = written(gone, "gone")
    return docs.join(gone, docs[ID].eqNullSafe(gone["gone_id"]), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, identify(docs, [ID], TEXT, declared_col="lang", host_col="source"), F.col("kept"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, exact_dedup(docs, ID, TEXT), F.coalesce("kept", F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, jaccard_components(docs, ID, TEXT), F.col("component_id").eqNullSafe(F.col(ID)))


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate(docs, read(spark, sf_dir, "benchmark"), ID, TEXT), ~F.col("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, ID, TEXT, source_col="source")


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("jaccard_join", near_duplicates),
          ("decontamination", benchmark_contamination), ("packing", packing)]

#: SQL cannot express the trained language stage or the packing loop; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
