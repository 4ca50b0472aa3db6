"""TF-IDF over long tables: term statistics, vocabulary, weights."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.functions import text as X
from revlens.functions.rows import each, largest
from revlens.functions.vectors import vector_values
from revlens.settings import TfidfOptions
from revlens.sources.scratch import Scratch


def with_terms(docs: DataFrame, *, normalized: bool = True) -> DataFrame:
    """Replace ``text`` by ``terms``: unigrams of two letters or more, and bigrams."""
    words = docs.withColumn("_words", X.tokens(F.col("text"), normalized=normalized))
    return words.withColumn("terms", X.with_bigrams(F.col("_words"))).drop("_words", "text")


def _counted_terms(docs: DataFrame, *keys: str) -> DataFrame:
    """Each document twice: all its terms, and its distinct terms. One shuffle on
    the term then gives both frequencies, without a count per document first."""
    both = F.array(
        F.struct(F.lit(1).alias("tf"), F.lit(0).alias("df"), F.col("terms").alias("terms")),
        F.struct(
            F.lit(0).alias("tf"), F.lit(1).alias("df"), F.array_distinct("terms").alias("terms")
        ),
    )
    rows = docs.select(*keys, F.inline_outer(both))
    return each(rows, "terms", *keys, "tf", "df", name="term")


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, tf, df): occurrences and documents. ``docs`` has ``terms``."""
    return (
        _counted_terms(docs)
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )


def top_terms(stats: DataFrame, options: TfidfOptions = TfidfOptions()) -> DataFrame:
    """Terms in enough documents, the most frequent ones first, numbered from 0
    in alphabetical order."""
    kept = (
        stats.where(F.col("df") >= options.min_df)
        .orderBy(F.desc("tf"), "term")
        .limit(options.max_features)
    )
    # At most max_features rows.
    return kept.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)


def smooth_idf(df: Column, docs: Column) -> Column:
    return F.log((1 + docs) / (1 + df)) + 1


def vocabulary(
    docs: DataFrame, n_docs: int, options: TfidfOptions = TfidfOptions()
) -> DataFrame:
    """(term, tf, df, idx, idf), at most ``max_features`` rows."""
    return top_terms(term_stats(docs), options).withColumn(
        "idf", smooth_idf(F.col("df"), F.lit(n_docs))
    )


def weigh(docs: DataFrame, vocab: DataFrame, *, normalized: bool = True) -> DataFrame:
    """(row_id, term, tf, weight): sublinear tf times idf, unit length per row.

    Terms outside the vocabulary (term, idx, idf) are ignored. A text becomes a
    count vector, is weighed and scaled inside its row, and only then becomes
    rows of terms, so nothing is shuffled. The vocabulary has at most
    ``max_features`` rows; it is read once and broadcast.
    """
    entries = vocab.select("term", "idx", "idf").collect()
    schema = "row_id long, term string, tf bigint, weight double"
    if not entries:
        return docs.sparkSession.createDataFrame([], schema)
    entries.sort(key=lambda r: r.idx)
    counter = CountVectorizerModel.from_vocabulary(
        [r.term for r in entries], inputCol="terms", outputCol="counts"
    )
    idf = F.lit(np.array([r.idf for r in entries]))
    terms = with_terms(docs.select("row_id", "text"), normalized=normalized)
    vector = vector_values(F.col("counts"))
    rows = counter.transform(terms).select(
        "row_id", vector["indices"].alias("idx"), vector["values"].alias("tf")
    )
    raw = F.zip_with("idx", "tf", lambda i, tf: (1 + F.log(tf)) * F.element_at(idf, i + 1))
    rows = rows.withColumn("raw", raw)
    # A column of its own below the rows of terms: once for each text.
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda total, x: total + x * x))
    rows = rows.withColumn("norm", norm)
    names = docs.sparkSession.createDataFrame([(r.idx, r.term) for r in entries], "idx int, term string")
    cells = rows.select("row_id", "norm", F.inline_outer(F.arrays_zip("idx", "tf", "raw")))
    weight = F.col("raw") / F.col("norm")
    return cells.join(F.broadcast(names), "idx").select(
        "row_id", "term", F.col("tf").cast("bigint").alias("tf"), weight.alias("weight")
    )


def _fold_totals(docs: DataFrame, folds: int, min_df: int) -> DataFrame:
    """One row per term that can reach ``min_df``, with tf and df outside each fold.

    Terms are counted by fold first, in two numbers a key; the wide rows are made of
    what is left."""

    def outside(count: str, fold: int) -> Column:
        return F.sum(F.when(F.col("fold") != fold, F.col(count)).otherwise(0))

    inside = _counted_terms(docs, "fold").groupBy("term", "fold").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return (
        inside.groupBy("term")
        .agg(
            F.sum("df").alias("df"),
            *[outside(c, f).alias(f"{c}_{f}") for f in range(1, folds + 1) for c in ("tf", "df")],
        )
        .where(F.col("df") >= min_df)
    )


def _by_fold(totals: DataFrame, folds: int, min_df: int) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("fold"), F.col(f"tf_{f}").alias("tf"), F.col(f"df_{f}").alias("df")
            )
            for f in range(1, folds + 1)
        ]
    )
    return totals.select("term", F.inline(rows)).where(F.col("df") >= min_df)


def fold_term_stats(docs: DataFrame, folds: int, min_df: int = 1) -> DataFrame:
    """(fold, term, tf, df) over the rows *outside* each fold. One count serves all
    folds, and only terms that can reach ``min_df`` are expanded by fold."""
    return _by_fold(_fold_totals(docs, folds, min_df), folds, min_df)


def _least_tf(stats: DataFrame, limit: int) -> DataFrame:
    """(fold, least): the tf of the last of the ``limit`` most frequent terms of each
    fold. One row per fold and tf is counted, no term is sorted."""
    sizes = stats.groupBy("fold", "tf").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("fold").orderBy(F.desc("tf"))) - F.col("n")
    reached = sizes.withColumn("above", above).where(F.col("above") < limit)
    return reached.groupBy("fold").agg(F.min("tf").alias("least"))


def fold_vocabularies(
    docs: DataFrame, folds: int, options: TfidfOptions = TfidfOptions(), scratch: Scratch | None = None
) -> DataFrame:
    """(fold, term, tf, df, idf): the vocabulary of each fold's training side.

    The counts are written once. Only terms that are frequent enough to be in a
    vocabulary are ranked."""
    scratch = scratch or Scratch(docs.sparkSession)
    totals = scratch.table(_fold_totals(docs, folds, options.min_df), "fold-totals")
    stats = _by_fold(totals, folds, options.min_df)
    per_fold = docs.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    # One row per fold.
    every = Window.partitionBy(F.lit(1))
    sizes = per_fold.select("fold", (F.sum("n").over(every) - F.col("n")).alias("n_train"))
    frequent = (
        stats.join(F.broadcast(_least_tf(stats, options.max_features)), "fold")
        .where(F.col("tf") >= F.col("least"))
        .drop("least")
    )
    best = largest(frequent, options.max_features, "fold", by=(F.desc("tf"), F.col("term")), key="term")
    return (
        best.join(F.broadcast(sizes), "fold")
        .select("fold", "term", "tf", "df", smooth_idf(F.col("df"), F.col("n_train")).alias("idf"))
    )
