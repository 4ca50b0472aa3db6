"""Find the first row of every key without moving the rows if possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlens.sources.scratch import Scratch

# A broadcast entry is a 32-byte digest and a row number: about 100 MB at most.
BROADCAST_KEYS = 1_000_000


def first_wins(
    rows: DataFrame,
    key: str,
    order: str,
    scratch: Scratch,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Rows whose ``order`` is the smallest of their ``key``.

    Only (key, order) is shuffled, combined before the shuffle, and only keys
    that occur more than once are kept. That table is written, so its size is
    known. If it is small it is broadcast and the rows, with their texts, do
    not move at all. If not, the most repeated keys are broadcast first (at most
    ``broadcast_keys`` of them, by the pigeonhole bound below), which settles
    the copies of every hot key in place; the other keys are few rows each and
    go through a shuffle join.
    """
    return _settle(rows, key, order, scratch, broadcast_keys, keep_all=False).drop("is_first")


def mark_first(
    rows: DataFrame,
    key: str,
    order: str,
    scratch: Scratch,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """All rows, with ``is_first``. Rows without a key are first."""
    return _settle(rows, key, order, scratch, broadcast_keys, keep_all=True)


def _settle(rows, key, order, scratch, broadcast_keys, keep_all) -> DataFrame:
    repeated = (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(order).alias("first_row"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    repeated = scratch.table(repeated, "repeated-keys")
    keys, copies = repeated.agg(F.count(F.lit(1)), F.sum("copies")).first()
    rows = rows.withColumn("is_first", F.lit(True))
    if keys <= broadcast_keys:
        return _join(rows, F.broadcast(repeated), key, order, keep_all).drop("settled")
    # No more than copies / hot keys can have `hot` copies each.
    hot = copies // broadcast_keys + 1
    rows = _join(
        rows, F.broadcast(repeated.where(F.col("copies") >= hot)), key, order, keep_all
    )
    # Settled rows and rows without a key get a join key of their own, so that
    # they spread over all tasks.
    spread = F.encode(F.col(order).cast("string"), "UTF-8")
    join_key = F.when(F.col("settled") | F.col(key).isNull(), spread).otherwise(F.col(key))
    cold = repeated.where(F.col("copies") < hot).withColumnRenamed(key, "join_key")
    rows = rows.withColumn("join_key", join_key).drop("settled")
    return _join(rows, cold, "join_key", order, keep_all).drop("settled", "join_key")


def _join(rows: DataFrame, firsts: DataFrame, key: str, order: str, keep_all: bool) -> DataFrame:
    joined = rows.join(firsts.select(key, "first_row"), key, "left")
    first = F.col("first_row").isNull() | (F.col("first_row") == F.col(order))
    joined = (
        joined.withColumn("is_first", F.col("is_first") & first)
        if keep_all
        else joined.where(first)
    )
    return joined.withColumn("settled", F.col("first_row").isNotNull()).drop("first_row")
