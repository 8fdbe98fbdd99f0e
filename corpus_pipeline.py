"""From raw documents to token ids, in stages that are written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeval.llm import decontam, neardup, pieces, quality, secret_scan
from sparkeval.llm.common import fresh, prepared
from sparkeval.plans.session import configure, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
NEAR = 80  # of the union of two documents' shingles that near copies share at least; op4's contract has 85


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy."""
    held = fresh(docs, "_quality")
    measured = quality.ledger(docs, into=held)
    return measured.filter(quality.passes(F.col(held)["failures"], 2)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, which share 80 % of their shingles: the one with the
    smallest id."""
    return neardup.first_of_each(docs, percent=NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, those of items without an id included."""
    held = fresh(docs, "_hits")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontam.contamination(docs, benchmark, into=held)
    return found.filter(F.col(held)["n_hit"] == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark, with their new lengths."""
    done = secret_scan.redact(docs)
    length = F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return done.withColumn("n_chars", length) if "n_chars" in docs.columns else done


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids per document, and whether decoding them gives the text again."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    decoded = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), model)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("exact")
    )


STAGES: list[tuple[str, Stage]] = [
    (name, lambda spark, docs, sf_dir, stage=stage: stage(configure(prepared(spark)), docs, sf_dir))
    for name, stage in (
        ("quality_rules", quality_rules),
        ("near_duplicates", near_duplicates),
        ("decontaminated", decontaminated),
        ("without_secrets", without_secrets),
        ("token_ids", token_ids),
    )
]
# Locality of compressed sizes and merges by rank have no SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is stored, and the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
