"""Registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontaminate import decontaminate
from .divergence import divergence
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language import declared_in_markup, identify
from .main_text import extract_main_text
from .manifest import LOWER, UPPER, leaf_digest, manifest
from .packing import pack
from .sharding import SHARDS, shard
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import score_toxicity
from .url_trust import url_verdicts

#: Fixed values of the url filter's contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"), shards=SHARDS)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source as host) and pages (markup language, address, host)
    in one corpus; ``doc_id`` or ``page_id`` is null in rows of the other table."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text",
                                                   F.col("lang").alias("declared"), F.lit(None).cast("string").alias("url"),
                                                   F.col("source").alias("host"))
    pages = read(spark, sf_dir, "pages")
    markup = declared_in_markup(F.col("html"))
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    pages = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", visible.alias("text"), markup.alias("declared"),
                         "url", F.lit(None).cast("string").alias("host"))
    return identify(docs.unionByName(pages), ["doc_id", "page_id"], "text", "declared", "url", "host")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against the manifest: texts whose A-Z are lower-cased, on a fifth of the rows."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = leaf_digest(*[F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in columns])
    held = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered).otherwise(
        leaf_digest(*[F.col(c) for c in columns]))
    return manifest(read(spark, sf_dir, "documents"), columns, held=held)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
