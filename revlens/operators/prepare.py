"""Raw review table to labelled, deduplicated table, with a count per reason for dropping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions import text as X
from revlens.operators.dedupe import first_wins, mark_first
from revlens.settings import LABEL_CODES, NEUTRAL_LABEL, TEXT_COLUMNS
from revlens.sources.readers import require_columns
from revlens.sources.scratch import Scratch


def _column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def label_rows(raw: DataFrame) -> DataFrame:
    """Raw rows with canonical label names."""
    require_columns(raw, ("row_id",))
    return raw.withColumn("label_name", X.normalize_label(_column_or_null(raw, "sentimen")))


def choose_text(rows: DataFrame) -> DataFrame:
    """``source_column`` and ``chosen``: the first text column that is not blank.

    If all are blank the last one is named. Blankness is tested on the raw
    value, so only the chosen text has to be normalised.
    """
    *preferred, last = TEXT_COLUMNS
    source = F.lit(last)
    for name in reversed(preferred):
        source = F.when(X.has_text(_column_or_null(rows, name)), F.lit(name)).otherwise(source)
    rows = rows.withColumn("source_column", source)
    chosen = _column_or_null(rows, last)
    for name in reversed(preferred):
        chosen = F.when(F.col("source_column") == name, _column_or_null(rows, name)).otherwise(
            chosen
        )
    return rows.withColumn("chosen", chosen)


def _known() -> Column:
    return F.col("label_name").isin(*LABEL_CODES)


PREPARED = ("row_id", "text", "label", "label_name", "kategori", "stars", "source_column")


def tag_rows(raw: DataFrame) -> DataFrame:
    """Every raw row in the prepared layout, with ``drop_reason`` and ``digest``.

    ``drop_reason`` is the first test a row fails, before deduplication; NULL
    means usable. Texts are normalised only where the label is known, and
    digests are made only for usable rows: JVM expressions inside a CASE are
    not evaluated for the other rows.
    """
    rows = choose_text(label_rows(raw))

    def clean(value: Column) -> Column:
        return F.when(_known(), X.normalize_text(value))

    rows = rows.select(
        "row_id",
        clean(F.col("chosen")).alias("text"),
        X.label_code(F.col("label_name")).alias("label"),
        "label_name",
        clean(_column_or_null(rows, "kategori")).alias("kategori"),
        clean(_column_or_null(rows, "stars")).alias("stars"),
        "source_column",
    )
    rows = rows.withColumn(
        "drop_reason",
        F.when(F.col("label_name") == NEUTRAL_LABEL, "netral")
        .when(~_known(), "other_label")
        .when(X.is_bad_text(F.col("text")), "bad_text"),
    )
    digest = X.key_digest(X.dedupe_key(F.col("text"), normalized=True))
    return rows.withColumn("digest", F.when(F.col("drop_reason").isNull(), digest))


def usable_rows(tagged: DataFrame) -> DataFrame:
    """Rows that pass the label and text tests, in the prepared layout plus ``digest``."""
    return tagged.where(F.col("drop_reason").isNull()).select(*PREPARED, "digest")


def prepare(raw: DataFrame, scratch: Scratch, dedupe: bool = True) -> DataFrame:
    """Prepared table: row_id, text, label, label_name, kategori, stars, source_column."""
    if not dedupe:
        return usable_rows(tag_rows(raw)).drop("digest")
    # Finding duplicates takes a pass over the digests and one over the rows.
    # Reading written rows is much cheaper than cleaning the texts twice.
    usable = scratch.table(usable_rows(tag_rows(raw)), "usable")
    return deduplicated(usable, scratch)


def deduplicated(usable: DataFrame, scratch: Scratch) -> DataFrame:
    return first_wins(usable, "digest", "row_id", scratch).select(*PREPARED)


def drop_reasons(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_id, drop_reason) for every raw row; NULL for kept rows."""
    rows = scratch.table(tag_rows(raw).select("row_id", "drop_reason", "digest"), "tags")
    rows = mark_first(rows, "digest", "row_id", scratch)
    reason = F.when(~F.col("is_first"), "duplicate").otherwise(F.col("drop_reason"))
    return rows.select("row_id", reason.alias("drop_reason"))


def summarize(tagged: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row of counts from ``tag_rows``. Only digests are shuffled: the kept
    rows are the distinct digests, so no join is needed, and a hot digest is
    already one row per task before the shuffle."""
    groups = (
        tagged.groupBy("drop_reason", "digest").agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("label", "row_id").alias("first_label"),
            F.count_if(F.col("label") == 0).alias("negatif"),
            F.count_if(F.col("label") == 1).alias("positif"),
        )
    )
    passed = F.col("drop_reason").isNull()

    def rows_with(reason: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("drop_reason") == reason, F.col("n"))), F.lit(0))

    def kept(one_per_key: Column, all_rows: str) -> Column:
        if dedupe:
            return F.count_if(passed & one_per_key)
        return F.coalesce(F.sum(F.when(passed, F.col(all_rows))), F.lit(0))

    return (
        groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("original_rows"),
            rows_with("netral").alias("dropped_netral"),
            rows_with("other_label").alias("dropped_other_label"),
            rows_with("bad_text").alias("dropped_bad_text"),
            F.coalesce(F.sum(F.when(passed, F.col("n"))), F.lit(0)).alias("usable"),
            kept(F.lit(True), "n").alias("kept_rows"),
            kept(F.col("first_label") == 0, "negatif").alias("negatif"),
            kept(F.col("first_label") == 1, "positif").alias("positif"),
        )
        .withColumn("dropped_duplicates", F.col("usable") - F.col("kept_rows"))
        .select(
            "original_rows",
            "dropped_netral",
            "dropped_other_label",
            "dropped_bad_text",
            "dropped_duplicates",
            "kept_rows",
            "negatif",
            "positif",
        )
    )


def label_counts(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))


def class_texts(prepared: DataFrame, label: int) -> DataFrame:
    return prepared.where(F.col("label") == label).select("row_id", "text")
