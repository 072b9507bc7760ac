"""A corpus pipeline of five text operators. Each stage takes (spark, docs, sf_dir), is written as
Parquet and read again for the next one; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard, line_dedup, packing, quality, toxicity
from colloquy.llm.common import staged, table
from colloquy.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules keep."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The scorer learns from all labelled documents of the
    input table, so that rejections made before do not bias it."""
    scorer = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, scorer)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one of which nothing is left goes, n_chars follows the text."""
    cut = line_dedup.without_repeats(docs).where((F.col("removed_chunks") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group linked at Jaccard 0.8 over five-word shingles.
    Of rows that repeat a doc_id all or none stay; rows with a null doc_id stay."""
    named = jaccard.jaccard_components(docs, width=5, num=80, den=100)
    later = named.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(staged(later, "later"), "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: Certified cutoffs, the label model and packing are not expressible in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs, name.replace(" ", "_"))
    return docs
