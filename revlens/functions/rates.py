"""Rates over the four cells of a binary confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CELLS = ("tn", "fp", "fn", "tp")


def count_cells(label: str = "label", prediction: str = "prediction") -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 if the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy() -> Column:
    tn, fp, fn, tp = map(F.col, CELLS)
    return ratio(tn + tp, tn + fp + fn + tp)


def precision(code: int = 1) -> Column:
    tn, fp, fn, tp = map(F.col, CELLS)
    return ratio(tp, tp + fp) if code else ratio(tn, tn + fn)


def recall(code: int = 1) -> Column:
    tn, fp, fn, tp = map(F.col, CELLS)
    return ratio(tp, tp + fn) if code else ratio(tn, tn + fp)


def f1(code: int = 1) -> Column:
    tn, fp, fn, tp = map(F.col, CELLS)
    hits = tp if code else tn
    return ratio(2 * hits, 2 * hits + fp + fn)


def support(code: int = 1) -> Column:
    tn, fp, fn, tp = map(F.col, CELLS)
    return tp + fn if code else tn + fp
