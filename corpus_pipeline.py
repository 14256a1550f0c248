"""A training corpus from documents: five stages, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import cotraining, packing, quality_rules, simhash, substring_dedup
from tracemill.llm.common import fresh_path, materialise, table, text_hash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps, with all their columns; odd rows are judged as in cotraining.score(), repeated ones alike."""
    return cotraining.passes(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees, with all their columns; null, empty and blank texts fail, repeated rows are judged alike."""
    return quality_rules.passes(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the least doc_id (null last), then text hash.

    Rows that repeat both are one document, of which one row stays; they are met
    before the shuffle. The rows are dealt by that key once, for this and for the
    join with the chosen keys.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    key = F.struct(F.col("doc_id").isNull().alias("void"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("th"))
    chosen = materialise(found.groupBy("root").agg(F.min(key).alias("k")).select("k.*"), "pipeline-chosen")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("void"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_hash().alias("th"))
    return keyed.dropDuplicates(["void", "id", "th"]).join(chosen, ["void", "id", "th"], "left_semi").select("row.*")


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one has."""
    return substring_dedup.dedup(docs, min_words=substring_dedup.LINE_WORDS, passage_words=substring_dedup.PASSAGE_WORDS).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring),
    ("best-fit packing", best_fit_packing),
]

#: Two stages fit models, so that SQL can't state the result; tests/llm holds it against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
