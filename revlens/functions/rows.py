"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.sources.scratch import Scratch

# Parts of a group that are ranked on their own.
BUCKETS = 64


def each(df: DataFrame, array: Column | str, *keep: str | Column, name: str) -> DataFrame:
    """One row per non-null element. A plain ``explode`` makes the optimizer test
    ``size(array) > 0`` first, below every projection, which would compute an
    array of tokens several times; an outer one does not."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def largest(
    df: DataFrame, limit: int, *group: str, by: tuple[Column, ...], key: str, buckets: int = BUCKETS
) -> DataFrame:
    """The first ``limit`` rows of each group in the order ``by``, with ``rank``.

    Rows are ranked inside hash parts of a group first, and only the first
    ``limit`` of each part meet in the group's own ranking: exact, and no task
    sorts a whole group. ``by`` must end in ``key``, so that ties are settled.
    """
    part = F.pmod(F.xxhash64(key), F.lit(buckets))
    inside = Window.partitionBy(*group, "_part").orderBy(*by)
    whole = Window.partitionBy(*group).orderBy(*by)
    return (
        df.withColumn("_part", part)
        .withColumn("rank", F.row_number().over(inside))
        .where(F.col("rank") <= limit)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= limit)
        .drop("_part")
    )


def numbered(df: DataFrame, scratch: Scratch, *by: Column, name: str) -> DataFrame:
    """Number all rows from 0 in the order ``by``, which must settle ties. Rows
    are cut into ranges of the order and numbered inside them; only the sizes of
    the ranges meet in one task."""
    ranged = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    ranged = scratch.table(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_range", "_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.col("_inside") - 1)
        .drop("_range", "_inside", "_offset")
    )
