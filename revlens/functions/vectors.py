"""Functions over arrays of scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax(logits: Column) -> Column:
    """Stable softmax: the largest logit is taken off first."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Zero-based index of the largest value; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def signed_weight(label_name: Column, weight: Column, positive: str = "Positif") -> Column:
    return F.when(label_name == positive, F.abs(weight)).otherwise(-F.abs(weight))


def vector_values(vector: Column) -> Column:
    """The (type, size, indices, values) struct behind an ML vector."""
    return F.unwrap_udt(vector)
