"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.llm import near_dup, packing, quality, secret_scan, substring
from revlens.llm.kit import Stage
from revlens.llm.queries import vocabulary


# Near-duplicate stages work on five-word shingles.
NEAR = near_dup.Options(shingle=5)


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest id, of each group of near copies."""
    return near_dup.first_of_each(docs, NEAR)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages."""
    return counted(substring.without_repeats(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by its kind."""
    return counted(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("packing", packed),
]

# Packing and substring removal are not SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written to the shared folder and read by the next one."""
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        done = stage.table(apply(spark, docs, sf_dir), name)
        stage.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
