"""Metrics of binary classifiers over a long table of predictions.

Input columns: the keys (for example feature, model, fold), ``label`` and
``prediction`` in {0, 1}, and a nullable ``score``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.functions import rates as R
from revlens.sources.scratch import Scratch

# Score ranges per group when distinct scores are ranked.
SCORE_RANGES = 64


def _unusable() -> Column:
    return F.col("score").isNull() | F.isnan("score")


def confusion_cells(predictions: DataFrame, *keys: str) -> DataFrame:
    """One row per group: tn, fp, fn, tp."""
    return predictions.groupBy(*keys).agg(*R.count_cells())


def confusion_matrix(predictions: DataFrame, *keys: str) -> DataFrame:
    """One row per group and cell, cells without rows included."""
    cells = confusion_cells(predictions, *keys)
    return cells.select(*keys, F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp)").alias(
        "label", "prediction", "n"
    ))


def score_table(predictions: DataFrame, *keys: str) -> DataFrame:
    """Distinct scores per group with their confusion cells. All metrics follow
    from it, so the predictions are read once."""
    return predictions.groupBy(*keys, "score").agg(*R.count_cells())


def _positives() -> Column:
    return F.col("tp") + F.col("fn")


def _negatives() -> Column:
    return F.col("tn") + F.col("fp")


def _ranged(scores: DataFrame, keys: tuple[str, ...], ranges: int) -> DataFrame:
    """Add ``range``: the number of cut points below the score.

    A group with 10^10 distinct scores must not be sorted by one task. Cut
    points from approximate quantiles give ranges of similar size; the results
    are exact whatever the cut points are. Missing scores are in range 0.
    """
    steps = [i / ranges for i in range(1, ranges)]
    # One row per group, with `ranges` numbers.
    cuts = (
        scores.where(~_unusable())
        .groupBy(*keys)
        .agg(F.percentile_approx("score", steps, F.lit(1000)).alias("cuts"))
    )
    below = F.when(~_unusable(), F.size(F.filter("cuts", lambda c: c < F.col("score"))))
    return (
        scores.join(F.broadcast(cuts), list(keys), "left")
        .withColumn("range", F.coalesce(below, F.lit(0)))
        .drop("cuts")
    )


def metrics_of(scores: DataFrame, *keys: str, ranges: int = SCORE_RANGES) -> DataFrame:
    """One row per group: n, accuracy, precision, recall, f1, roc_auc.

    For the AUC every positive counts the negatives below it and half of those
    tied with it: inside its range by a running sum, and all of the lower ranges
    at once. It is NULL where a class is missing or any score is.
    """
    inside = Window.partitionBy(*keys, "range").orderBy("score")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    wins = _positives().cast("double") * (F.col("_below") + _negatives() / 2.0)
    per_range = (
        _ranged(scores, keys, ranges)
        .withColumn("_below", F.coalesce(F.sum(_negatives()).over(before), F.lit(0)))
        .groupBy(*keys, "range")
        .agg(
            *[F.sum(c).alias(c) for c in R.CELLS],
            F.sum(wins).alias("wins"),
            F.count_if(_unusable()).alias("gaps"),
        )
    )
    # At most `ranges` rows per group from here on.
    lower = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    all_wins = F.col("wins") + _positives().cast("double") * F.coalesce(F.col("_lower"), F.lit(0))
    pairs = F.expr("CAST(tp + fn AS DOUBLE) * (tn + fp)")
    return (
        per_range.withColumn("_lower", F.sum(_negatives()).over(lower))
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in R.CELLS],
            F.sum(all_wins).alias("wins"),
            F.sum("gaps").alias("gaps"),
        )
        .select(
            *keys,
            reduce(lambda a, b: a + b, map(F.col, R.CELLS)).alias("n"),
            R.accuracy().alias("accuracy"),
            R.precision().alias("precision"),
            R.recall().alias("recall"),
            R.f1().alias("f1"),
            F.when(F.col("gaps") == 0, F.try_divide(F.col("wins"), pairs)).alias("roc_auc"),
        )
    )


def metrics(predictions: DataFrame, *keys: str, scratch: Scratch) -> DataFrame:
    return metrics_of(scratch.table(score_table(predictions, *keys), "scores"), *keys)


def fold_and_pooled_metrics(predictions: DataFrame, *keys: str, scratch: Scratch) -> DataFrame:
    """Metrics per (keys, fold) and over all folds together (``fold`` NULL).

    Both levels come from rows already combined by fold, so the second level
    adds no pass over the predictions. The pooled AUC ranks all scores of the
    candidate together; it is not the mean of the fold values.
    """
    per_fold = score_table(predictions.withColumn("fold", F.col("fold").cast("int")), *keys, "fold")
    levels = [[*keys, "fold", "score"], [*keys, "score"]]
    both = (
        per_fold.groupingSets([[F.col(c) for c in level] for level in levels], *levels[0])
        .agg(*[F.sum(c).alias(c) for c in R.CELLS])
        # Fold 0 stands for all folds until the end, since NULL does not join.
        .withColumn("fold", F.coalesce("fold", F.lit(0)))
    )
    return metrics_of(scratch.table(both, "scores"), *keys, "fold").withColumn(
        "fold", F.when(F.col("fold") > 0, F.col("fold"))
    )


def roc_points(
    predictions: DataFrame,
    *keys: str,
    scratch: Scratch,
    drop_collinear: bool = False,
    ranges: int = SCORE_RANGES,
) -> DataFrame:
    """(keys, threshold, fpr, tpr): one point per distinct score, and the start
    point with an infinite threshold. Only groups with both classes and all
    scores have a curve.

    ``drop_collinear`` leaves out the points in the middle of a straight line,
    which a chart does not need.
    """
    keys = tuple(keys)
    scores = scratch.table(score_table(predictions, *keys), "scores")
    # Written, because the offsets below and the points must see the same cuts.
    ranged = scratch.table(_ranged(scores, keys, ranges), "score-ranges")
    above = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("range"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    following = Window.partitionBy(*keys).orderBy(F.desc("range"))
    group = Window.partitionBy(*keys)
    # At most `ranges` rows per group, here and in the two broadcasts.
    offsets = (
        ranged.groupBy(*keys, "range")
        .agg(
            F.sum(_positives()).alias("_pos"),
            F.sum(_negatives()).alias("_neg"),
            F.max_by(F.struct(_positives().alias("pos"), _negatives().alias("neg")), "score").alias("_top"),
            F.count_if(_unusable()).alias("_gaps"),
        )
        .select(
            *keys,
            "range",
            F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("neg_above"),
            F.lead("_top").over(following).alias("next_top"),
            F.sum("_pos").over(group).alias("all_pos"),
            F.sum("_neg").over(group).alias("all_neg"),
            F.sum("_gaps").over(group).alias("_gaps"),
        )
        .where("_gaps = 0 AND all_pos > 0 AND all_neg > 0")
        .drop("_gaps")
    )
    inside = Window.partitionBy(*keys, "range").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    step = F.struct(_positives().alias("pos"), _negatives().alias("neg"))
    points = (
        ranged.withColumn("_tp", F.sum(_positives()).over(running))
        .withColumn("_fp", F.sum(_negatives()).over(running))
        .withColumn("_step", step)
        .withColumn("_next", F.lead("_step").over(inside))
        .join(F.broadcast(offsets), [*keys, "range"])
        .withColumn("above_tp", F.col("pos_above") + F.col("_tp"))
        .withColumn("above_fp", F.col("neg_above") + F.col("_fp"))
    )
    if drop_collinear:
        after = F.coalesce("_next", "next_top")
        is_first = (F.col("above_tp") == _positives()) & (F.col("above_fp") == _negatives())
        points = points.where(is_first | after.isNull() | (after != F.col("_step")))
    curve = points.select(
        *keys,
        F.col("score").alias("threshold"),
        (F.col("above_fp") / F.col("all_neg")).alias("fpr"),
        (F.col("above_tp") / F.col("all_pos")).alias("tpr"),
    )
    start = offsets.select(
        *keys,
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    ).distinct()
    return curve.unionByName(start)


def class_report(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, class, precision, recall, f1_score, support): both classes, the
    accuracy (as f1_score), and the macro and weighted averages."""
    cells = confusion_cells(predictions, *keys)
    for code in (0, 1):
        for name, rate in (("p", R.precision), ("r", R.recall), ("f", R.f1), ("s", R.support)):
            cells = cells.withColumn(f"{name}{code}", rate(code).cast("double"))
    total = F.col("s0") + F.col("s1")

    def macro(name: str) -> Column:
        return (F.col(f"{name}0") + F.col(f"{name}1")) / 2.0

    def weighted(name: str) -> Column:
        hits = F.col(f"{name}0") * F.col("s0") + F.col(f"{name}1") * F.col("s1")
        return R.ratio(hits, total)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1_score"),
            s.alias("support"),
        )

    nothing = F.lit(None).cast("double")
    rows = [
        row("Negatif", *map(F.col, ("p0", "r0", "f0", "s0"))),
        row("Positif", *map(F.col, ("p1", "r1", "f1", "s1"))),
        row("accuracy", nothing, nothing, R.accuracy(), total),
        row("macro avg", macro("p"), macro("r"), macro("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    ]
    return cells.select(*keys, F.inline(F.array(*rows)))


def report_documents(report: DataFrame, *keys: str, digits: int | None = None) -> DataFrame:
    """One JSON document per group from ``class_report`` rows (five per group)."""

    def number(name: str) -> Column:
        return F.round(name, digits) if digits is not None else F.col(name)

    def section(name: str) -> Column:
        fields = F.struct(
            number("precision").alias("precision"),
            number("recall").alias("recall"),
            number("f1_score").alias("f1-score"),
            F.col("support"),
        )
        return F.max(F.when(F.col("class") == name, fields)).alias(name)

    accuracy = F.max(F.when(F.col("class") == "accuracy", number("f1_score"))).alias("accuracy")
    sections = ["Negatif", "Positif", "accuracy", "macro avg", "weighted avg"]
    grouped = report.groupBy(*keys).agg(
        *[accuracy if name == "accuracy" else section(name) for name in sections]
    )
    document = F.to_json(F.struct(*[F.col(f"`{name}`") for name in sections]))
    return grouped.select(*keys, document.alias("report"))


def rank_candidates(
    results: DataFrame, prefix: str = "", tie_break: str = "candidate_id"
) -> DataFrame:
    """Best first by F1, then AUC, then accuracy; missing values last."""
    order = [F.desc_nulls_last(f"{prefix}{m}") for m in ("f1", "roc_auc", "accuracy")]
    return results.orderBy(*order, tie_break)


def best_candidate(
    results: DataFrame, prefix: str = "", tie_break: str = "candidate_id"
) -> DataFrame:
    return rank_candidates(results, prefix, tie_break).limit(1)
