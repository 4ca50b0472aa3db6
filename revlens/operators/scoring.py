"""Score new reviews with a fitted pipeline. Every step works on one row, so
the same functions serve batch tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from revlens.functions import text as X
from revlens.functions import vectors as V
from revlens.operators.classifiers import has_probability
from revlens.settings import BLANK_TEXT_MESSAGE, NO_MODEL_MESSAGE
from revlens.sources.scratch import path_exists

SCORES = ("p_negatif", "p_positif", "label_name", "message")


def positive_probability(
    probability: Column | None, margin: Column | None, prediction: Column
) -> Column:
    """The probability if there is one, else a squashed margin, else certainty."""
    options = [probability] if probability is not None else []
    if margin is not None:
        options.append(V.sigmoid(margin))
    return F.coalesce(*options, F.when(prediction == 1, 1.0).otherwise(0.0))


def finish_scores(rows: DataFrame, positive: Column, prediction: Column, source: str) -> DataFrame:
    """Scores, label and message; a blank text gets scores of 0 and no label."""
    blank = F.col("text") == ""
    label = X.label_title(prediction.cast("int"))
    return (
        rows.withColumn("p_positif", F.when(blank, 0.0).otherwise(positive))
        .withColumn("p_negatif", F.when(blank, 0.0).otherwise(1.0 - positive))
        .withColumn("label_name", F.when(~blank, label))
        .withColumn(
            "message",
            F.when(blank, BLANK_TEXT_MESSAGE).otherwise(F.concat(label, F.lit(f" - {source}"))),
        )
    )


def clean_reviews(rows: DataFrame, column: str = "text") -> DataFrame:
    return rows.withColumn("text", X.normalize_text(F.col(column)))


def score_reviews(rows: DataFrame, model: PipelineModel | None, column: str = "text") -> DataFrame:
    """Input columns plus ``SCORES``. Without a model all scores are 0."""
    keep = rows.columns
    clean = clean_reviews(rows, column)
    if model is None:
        nothing = F.lit(0.0)
        return clean.select(
            *keep,
            nothing.alias("p_negatif"),
            nothing.alias("p_positif"),
            F.lit(None).cast("string").alias("label_name"),
            F.when(F.col("text") == "", BLANK_TEXT_MESSAGE).otherwise(NO_MODEL_MESSAGE).alias("message"),
        )
    classifier = model.stages[-1]
    scored = model.transform(clean)
    column_of = lambda name: vector_to_array(F.col(name))[1]
    positive = positive_probability(
        column_of("probability") if has_probability(classifier) else None,
        None if has_probability(classifier) else column_of("rawPrediction"),
        F.col("prediction"),
    )
    return finish_scores(scored, positive, F.col("prediction"), "classical").select(*keep, *SCORES)


def score_logits(
    rows: DataFrame,
    inputs: Sequence[str],
    make_predict: Callable[[], Callable[..., np.ndarray]],
    *,
    batch_size: int = 16,
    labels: int = 2,
) -> DataFrame:
    """Scores of an external model. ``make_predict`` loads it once per Python
    worker and returns a function from batches of ``inputs`` to logits.

    Such a function cannot be kept from running on blank rows by a CASE, so
    the rows are not tested here: blank texts are overruled afterwards.
    """
    infer = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    keep = rows.columns
    scored = rows.withColumn("logits", infer(*[F.col(c) for c in inputs]))
    scored = scored.withColumn("_p", V.softmax(F.col("logits")))
    return finish_scores(
        scored, F.col("_p")[1], V.argmax(F.col("logits")), "transformer"
    ).select(*keep, "logits", *SCORES)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_first_model(spark: SparkSession, paths: Sequence[str]) -> PipelineModel | None:
    """The first of the paths that holds a model, or None."""
    for path in paths:
        if path and path_exists(spark, f"{path}/metadata"):
            return PipelineModel.load(path)
    return None
