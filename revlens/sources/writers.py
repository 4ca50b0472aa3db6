"""Output tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions import text as X
from revlens.sources.readers import CSV_OPTIONS


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()
) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by).format(fmt)
    (writer.options(**CSV_OPTIONS) if fmt == "csv" else writer).save(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report of bounded size (ranked candidates, top words), as one file."""
    write_table(df.coalesce(1), path, fmt)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row of a one-column table."""
    df.write.mode("overwrite").text(path)


def summary_document(summary: DataFrame, input_file: str, output_file: str) -> DataFrame:
    """One-row preparation summary as a JSON document."""
    labels = F.map_from_arrays(
        F.array(F.lit("Negatif"), F.lit("Positif")), F.array("negatif", "positif")
    )
    return summary.select(
        F.to_json(
            F.struct(
                F.lit(input_file).alias("input_file"),
                F.lit(output_file).alias("output_file"),
                "original_rows",
                "dropped_netral",
                "dropped_other_label",
                "dropped_bad_text",
                "dropped_duplicates",
                "kept_rows",
                labels.alias("labels"),
            )
        ).alias("value")
    )


def prediction_frame(scored: DataFrame, *keys: str) -> DataFrame:
    """Rows with label names and scores, as saved for a test or out-of-fold run."""
    return scored.select(
        *keys,
        "text",
        "label",
        X.label_title(F.col("label")).alias("label_name"),
        "prediction",
        X.label_title(F.col("prediction")).alias("prediction_name"),
        "score",
        *(c for c in scored.columns if c == "score_kind"),
    )


def document(*columns: str | Column) -> Column:
    """The columns as one JSON object; missing values are kept as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
