"""Review tables derived from the given tables, the same in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.operators import prepare as P
from revlens.operators.split import stratified_folds
from revlens.sources.readers import spread
from revlens.sources.scratch import Scratch

# For the given texts, which are in other languages than the default lists.
SEEDS = ("are", "be", "for", "erha", "ernt", "thst", "of", "from", "that", "anth", "worthless", "zzz")
STOPWORDS = ("the", "of", "and", "to", "in", "is", "it", "on")
FOLDS = 10
SEED = 42

# (candidate_id, feature, model); 3 has no scores, 4 sees one class only and 5
# never predicts the positive class.
CANDIDATES = (
    (1, "tfidf", "linear_svm"),
    (2, "tfidf", "logistic_regression"),
    (3, "word2vec", "linear_svm"),
    (4, "word2vec", "extra_trees"),
    (5, "word2vec", "logistic_regression"),
)


TEXT_KEYS = {"documents": ("doc_id",), "conversations": ("conv_id", "turn"), "benchmark": ("item_id",)}
# A session over a small folder, with one row group a table, may name a number of
# tasks here. Without it the tables are read as they are.
INPUT_PARTITIONS = "spark.revlens.input.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return spread(df, int(parts), *TEXT_KEYS[name]) if parts and name in TEXT_KEYS else df


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    labels = labels.select("doc_id", "quality")
    case = F.expr(
        """CASE WHEN quality = 1 THEN ' POSITIF' WHEN quality = 0 THEN 'Negatif'
                WHEN doc_id % 3 = 0 THEN 'Netral' WHEN doc_id % 3 = 1 THEN 'campuran'
                ELSE 'negatif ' END"""
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        case.alias("sentimen"),
        F.col("source").alias("kategori"),
        F.expr("CAST(1 + doc_id % 5 AS STRING)").alias("stars"),
        F.expr(
            "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '   ' ELSE text END"
        ).alias("perbaikan"),
        F.expr("CASE WHEN doc_id % 8 IN (0, 1) THEN NULL ELSE text END").alias("textTranslated"),
        F.expr("CASE WHEN doc_id % 40 = 0 THEN ' N/A ' ELSE text END").alias("text"),
    )


class Inputs:
    """The derived tables of one data folder in one application.

    The prepared table and the table of predictions are written once and read by
    column, as in the jobs: they are made first and analysed many times.
    """

    _known: dict[tuple[str, str], Inputs] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.scratch = Scratch(spark)
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Inputs:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known or cls._known[key].spark is not spark:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def raw(self) -> DataFrame:
        return reviews_raw(self.spark, self.sf_dir)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.scratch.table(make(), name)
        return self._tables[name]

    @property
    def prepared(self) -> DataFrame:
        return self._once("prepared", lambda: P.prepare(self.raw, self.scratch))

    @property
    def scored(self) -> DataFrame:
        """(row_id, label, fold, candidate_id, feature, model, score, prediction)"""
        return self._once("scored", self._score)

    def folds(self) -> DataFrame:
        """(row_id, label, fold)"""
        return stratified_folds(self.prepared.select("row_id", "label"), FOLDS, SEED)

    def _score(self) -> DataFrame:
        """Predictions of five candidates, by integer arithmetic."""
        candidates = F.array(
            *[
                F.struct(
                    F.lit(i).alias("candidate_id"), F.lit(f).alias("feature"), F.lit(m).alias("model")
                )
                for i, f, m in CANDIDATES
            ]
        )
        rows = self.folds().select("row_id", "label", "fold", F.inline(candidates))
        points = (F.col("row_id") * 37 + F.col("candidate_id") * 11) % 101 + 25 * F.col("label")
        value = points.cast("double") / F.lit(126).cast("double")
        return (
            rows.where((F.col("candidate_id") != 4) | (F.col("label") == 1))
            .withColumn("value", value)
            .withColumn("score", F.when(F.col("candidate_id") != 3, F.col("value")))
            .withColumn(
                "prediction",
                F.when((F.col("value") >= 0.5) & (F.col("candidate_id") != 5), 1).otherwise(0),
            )
            .drop("value")
        )
