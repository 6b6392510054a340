"""The corpus pipeline: quality, near-duplicates, repeats, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return
the columns of documents. The caller writes each stage's rows and reads them again
for the next; ``run`` does so in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathspring.llm import decontaminate, mixing, near_dup, quality, substring
from pathspring.llm._store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op9 accepts; each row is judged by itself, whatever its doc_id."""
    return quality.keep_accepted(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of op5 (similarity 0.8 or more): the one with the smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together. A row without a
    doc_id is linked with nothing and stays.
    """
    kept = near_dup.link_documents(docs).filter("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that op2 removes; n_chars follows the text. Rows without a doc_id take no part and stay as they are."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which op6 finds no benchmark window; each row without a doc_id is judged by itself."""
    key = next(k for i in range(len(docs.columns) + 1) if (k := f"key{i}") not in {c.lower() for c in docs.columns})
    nameless = written(docs.filter("doc_id is null").withColumn(key, F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))), "nameless")
    keyed = docs.filter("doc_id is not null").withColumn(key, F.concat(F.lit("="), F.col("doc_id").cast("string"))).unionByName(nameless)
    found = decontaminate.decontaminate(keyed, _table(spark, sf_dir, "benchmark"), id_col=key)
    leaks = found.filter("contaminated").select(F.col("doc_id").alias(key))
    return keyed.join(leaks, key, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix of op7 takes: a row for each document, repeated rows and rows without a doc_id too."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Perplexities and pseudorandom draws have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None
