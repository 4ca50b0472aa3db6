"""Equi-joins in which hot keys are split over many tasks.

A mergeable frequent-items sketch finds the keys that hold more than a fixed
share of the rows. Only these are salted: their rows spread over as many salts as
their share asks for, and the other side's rows of these keys are repeated once
for each salt. All other keys are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A key that holds more than one of so many equal parts of the rows, for each
# shuffle partition, is split into parts of that size.
PARTS_PER_PARTITION = 16
# The sketch's counters for each part; its error is a small share of one part.
COUNTERS_PER_PART = 8
MOST_PARTS = 8192


def parts_for(spark: SparkSession) -> int:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_PARTS, PARTS_PER_PARTITION * partitions)


def _hash(on: list[str]) -> Column:
    return F.xxhash64(*on)


def heavy_keys(rows: DataFrame, on: list[str], parts: int | None = None) -> dict[int, int]:
    """Hash of each hot key and its number of salts: fewer than ``parts`` keys,
    and fewer than twice as many salts. One pass, combined before the shuffle."""
    parts = parts or parts_for(rows.sparkSession)
    tracked = 1 << (parts * COUNTERS_PER_PART - 1).bit_length()
    sketch = F.expr(f"approx_top_k(_key, {parts}, {tracked})")
    counted = rows.select(_hash(on).alias("_key"))
    found = counted.agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    size = max(1, -(-found.n // parts))
    return {item: -(-count // size) for item, count in found.top or [] if count > size}


def _salts(rows: DataFrame, on: list[str], heavy: dict[int, int]) -> DataFrame:
    table = rows.sparkSession.createDataFrame(list(heavy.items()), "_key long, _salts long")
    return rows.withColumn("_key", _hash(on)).join(F.broadcast(table), "_key", "left")


def salted(rows: DataFrame, on: list[str], spread: Column, heavy: dict[int, int]) -> DataFrame:
    """``rows`` with ``_salt``: 0, but for hot keys by the hash of ``spread``."""
    salt = F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))
    return _salts(rows, on, heavy).withColumn("_salt", salt).drop("_key", "_salts")


def repeated(rows: DataFrame, on: list[str], heavy: dict[int, int]) -> DataFrame:
    """``rows`` once for each salt of their key."""
    last = F.coalesce("_salts", F.lit(1)) - 1
    every = F.explode(F.sequence(F.lit(0).cast("long"), last))
    return _salts(rows, on, heavy).withColumn("_salt", every).drop("_key", "_salts")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: Column,
    *,
    how: str = "inner",
    heavy: dict[int, int] | None = None,
) -> DataFrame:
    """``left`` joined with ``right`` (inner or left), hot keys of ``left`` split.

    ``spread`` must take many values among the rows of a hot key, and depend on
    the row alone, so that a task that runs again deals them out alike. ``right``
    should have few rows for each key. Without ``heavy``, ``left`` is read once
    more to find the hot keys, so it should be a written table.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    heavy = heavy_keys(left, on) if heavy is None else heavy
    if not heavy:
        return left.join(right, on, how)
    joined = salted(left, on, spread, heavy).join(repeated(right, on, heavy), [*on, "_salt"], how)
    return joined.drop("_salt")
