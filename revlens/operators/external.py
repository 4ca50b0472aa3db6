"""Hold-out evaluation of models that were trained elsewhere, from their logits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from revlens.functions import text as X
from revlens.functions import vectors as V
from revlens.operators import evaluate as E
from revlens.sources.scratch import Scratch

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


@dataclass
class ExternalRuns:
    """``results``: (model_id, slug, train_rows, valid_rows, test_rows, eval_metrics,
    test_metrics); ``failures``: (model_id, error); ``predictions``: (model_id,
    row_id, label, split, prediction, score) of the models with results."""

    results: DataFrame
    failures: DataFrame
    predictions: DataFrame


def usable_logits(logits: DataFrame) -> DataFrame:
    """Rows with two finite logits."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return logits.where((F.size("logits") == 2) & F.forall("logits", finite))


def external_runs(held: DataFrame, logits: DataFrame, models: DataFrame, scratch: Scratch) -> ExternalRuns:
    """``held``: (row_id, label, split); ``logits``: (model_id, row_id, logits);
    ``models``: the asked (model_id), few rows.

    A model needs exactly one pair of finite logits for each validation and test
    row; other models are failures. Logits of training rows are not read.
    """
    sizes = {r["split"]: r["n"] for r in held.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    needed = sizes.get("valid", 0) + sizes.get("test", 0)
    scored = (
        usable_logits(logits)
        .join(held.where("split <> 'train'"), "row_id")
        .select(
            "model_id",
            "row_id",
            "label",
            "split",
            V.argmax(F.col("logits")).alias("prediction"),
            V.softmax(F.col("logits"))[1].alias("score"),
        )
    )
    scored = scratch.table(scored, "external-scores")
    found = scored.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("rows")
    )
    status = scratch.table(
        models.select("model_id").distinct().join(found, "model_id", "left").fillna(0, ["n", "rows"]),
        "external-status",
    )
    whole = (F.col("n") == needed) & (F.col("rows") == needed)
    failures = status.where(~whole).select(
        "model_id", F.format_string(f"%d logits for %d of {needed} rows", "n", "rows").alias("error")
    )
    done = status.where(whole).select("model_id")
    # One row for each asked model.
    predictions = scored.join(F.broadcast(done), "model_id", "left_semi")
    metrics = E.metrics(predictions, "model_id", "split", scratch=scratch)
    part = lambda split: F.max(F.when(F.col("split") == split, F.struct(*METRICS)))
    both = metrics.groupBy("model_id").agg(
        part("valid").alias("eval_metrics"), part("test").alias("test_metrics")
    )
    results = done.join(both, "model_id", "left").select(
        "model_id",
        X.slug(F.col("model_id")).alias("slug"),
        *[F.lit(sizes.get(s, 0)).cast("bigint").alias(f"{s}_rows") for s in ("train", "valid", "test")],
        "eval_metrics",
        "test_metrics",
    )
    return ExternalRuns(results, failures, predictions)


def flatten(results: DataFrame) -> DataFrame:
    """``eval_`` and ``test_`` columns instead of the two structs."""
    flat = [
        F.col(f"{part}_metrics.{m}").alias(f"{part}_{m}") for part in ("eval", "test") for m in METRICS
    ]
    kept = [c for c in results.columns if not c.endswith("_metrics")]
    return results.select(*kept, *flat)
