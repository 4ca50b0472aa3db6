"""Reproducible stratified folds, hold-out splits and class weights.

Rows are ordered inside their class by a hash of (seed, row_id), so a split
depends neither on the order of the input nor on its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# 16^3 hash ranges per class: one range of a class of 10^10 rows holds 2.4
# million narrow rows, and the table of range counts stays under 10,000 rows.
HASH_DIGITS = 3




def with_class_rank(
    rows: DataFrame,
    seed: int = 42,
    *,
    label: str = "label",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Add ``class_rank`` (1-based, inside the class), ``position`` (0-based,
    classes one after the other in order of first appearance) and ``class_size``.

    A window over the whole class would put it in one task. Instead the leading
    hash digits cut each class into ranges, which keep the order: range counts
    give every range its offset, and rows are ranked only inside their range.
    """
    hashed = rows.withColumn(
        "_hash", _hash_of(F.col("row_id"), seed)
    ).withColumn("_range", F.substring("_hash", 1, digits))
    by_class = Window.partitionBy(label)
    # All windows here run over the range counts: classes x 16^digits rows.
    offsets = (
        hashed.groupBy(label, "_range")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("_first"))
        .withColumn("class_size", F.sum("_n").over(by_class))
        .withColumn("_class_first", F.min("_first").over(by_class))
        .withColumn(
            "_class_offset",
            F.coalesce(
                F.sum("_n").over(
                    by_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_class_first", label, "_range").rowsBetween(
                        Window.unboundedPreceding, -1
                    )
                ),
                F.lit(0),
            ),
        )
        .select(label, "_range", "class_size", "_class_offset", "_offset")
    )
    inside = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_hash", "row_id"))
    return (
        hashed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), [label, "_range"])
        .withColumn("class_rank", F.col("_class_offset") + F.col("_inside"))
        .withColumn("position", F.col("_offset") + F.col("_inside") - 1)
        .drop("_hash", "_range", "_inside", "_class_offset", "_offset")
    )


def stratified_folds(rows: DataFrame, folds: int = 10, seed: int = 42, **kw) -> DataFrame:
    """Add ``fold`` in 1..folds; class counts per fold differ by one at most."""
    ranked = with_class_rank(rows, seed, **kw)
    fold = (F.col("position") % folds + 1).cast("int")
    return ranked.withColumn("fold", fold).drop("class_rank", "position", "class_size")


def _quota(frame: DataFrame, name: str, draws: Column, size: str, total: Column) -> DataFrame:
    """Largest-remainder share of ``draws`` for each class, in exact arithmetic.
    The frame has one row per class."""
    every = Window.partitionBy(F.lit(1))
    exact = draws.cast("decimal(18,0)") * F.col(size).cast("decimal(18,0)")
    whole = total.cast("decimal(18,0)")
    return (
        frame.withColumn("_floor", F.floor(exact / whole).cast("bigint"))
        .withColumn("_rest", exact % whole)
        .withColumn("_missing", draws - F.sum("_floor").over(every))
        .withColumn(
            "_turn",
            F.row_number().over(every.orderBy(F.desc("_rest"), F.col("label"))),
        )
        .withColumn(
            name, F.col("_floor") + F.when(F.col("_turn") <= F.col("_missing"), 1).otherwise(0)
        )
        .drop("_floor", "_rest", "_missing", "_turn")
    )


def holdout_quotas(rows: DataFrame, test: float = 0.10, valid: float = 0.111111) -> DataFrame:
    """Rows per class and split: one row per class."""
    every = Window.partitionBy(F.lit(1))
    classes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    classes = classes.withColumn("_all", F.sum("n").over(every)).withColumn(
        "_kept", F.col("_all") - F.ceil(F.lit(test) * F.col("_all"))
    )
    classes = _quota(classes, "_rest_n", F.col("_kept"), "n", F.col("_all"))
    classes = classes.withColumn(
        "_train", F.col("_kept") - F.ceil(F.lit(valid) * F.col("_kept"))
    )
    classes = _quota(classes, "train_n", F.col("_train"), "_rest_n", F.col("_kept"))
    return classes.select(
        "label",
        "n",
        (F.col("n") - F.col("_rest_n")).alias("test_n"),
        (F.col("_rest_n") - F.col("train_n")).alias("valid_n"),
        "train_n",
    )


def _hash_of(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


def class_cuts(rows: DataFrame, quotas: DataFrame, seed: int, digits: int = HASH_DIGITS) -> DataFrame:
    """(label, name, cut_hash, cut_row): the last row of each named cut, in the
    order of (hash, row_id) inside its class. ``quotas`` has (label, name, rank),
    few rows; ranks of 0 have no row.

    Counts by hash range narrow every cut down to one range, and only the rows of
    these ranges are ranked.
    """
    narrow = rows.select("label", "row_id", _hash_of(F.col("row_id"), seed).alias("_hash"))
    narrow = narrow.withColumn("_range", F.substring("_hash", 1, digits))
    # Classes x 16^digits rows.
    up_to = Window.partitionBy("label").orderBy("_range")
    ranges = (
        narrow.groupBy("label", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(up_to))
    )
    wanted = ranges.join(F.broadcast(quotas), "label").where(
        (F.col("rank") <= F.col("_end")) & (F.col("rank") > F.col("_end") - F.col("_n"))
    )
    wanted = wanted.select("label", "_range", "name", (F.col("rank") - F.col("_end") + F.col("_n")).alias("_place"))
    # One range for each cut; two cuts of a class may share one.
    found = narrow.join(F.broadcast(wanted), ["label", "_range"])
    inside = Window.partitionBy("label", "_range", "name").orderBy("_hash", "row_id")
    return (
        found.withColumn("_at", F.row_number().over(inside))
        .where(F.col("_at") == F.col("_place"))
        .select("label", "name", F.col("_hash").alias("cut_hash"), F.col("row_id").alias("cut_row"))
    )


def holdout(
    rows: DataFrame,
    seed: int = 42,
    test: float = 0.10,
    valid: float = 0.111111,
) -> DataFrame:
    """Add ``split``: test first, then valid out of the rest, both stratified.

    Each class has two cuts; its rows compare themselves with them where they
    lie, so no row moves or is sorted but those of the two ranges of the cuts.
    """
    # Two rows per class.
    ends = F.array(
        F.struct(F.lit("test").alias("name"), F.col("test_n").alias("rank")),
        F.struct(F.lit("valid").alias("name"), (F.col("test_n") + F.col("valid_n")).alias("rank")),
    )
    quotas = holdout_quotas(rows, test, valid).select("label", F.inline(ends))
    cuts = class_cuts(rows, quotas, seed).groupBy("label").agg(
        *[
            F.max(F.when(F.col("name") == name, F.struct("cut_hash", "cut_row"))).alias(f"_{name}")
            for name in ("test", "valid")
        ]
    )
    own = F.struct(_hash_of(F.col("row_id"), seed).alias("cut_hash"), F.col("row_id").alias("cut_row"))
    split = (
        F.when(F.coalesce(own <= F.col("_test"), F.lit(False)), "test")
        .when(F.coalesce(own <= F.col("_valid"), F.lit(False)), "valid")
        .otherwise("train")
    )
    marked = rows.join(F.broadcast(cuts), "label", "left").withColumn("split", split)
    return marked.select(*rows.columns, "split")


def fold_sides(rows: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, valid) of one fold."""
    return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)


def class_weights(rows: DataFrame, *keys: str) -> DataFrame:
    """Balanced weights ``n / (classes * class_n)``, per key if keys are given."""
    counts = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    # One row per key and class.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    weight = F.sum("n").over(group) / (F.count(F.lit(1)).over(group) * F.col("n"))
    return counts.withColumn("weight", weight)
