"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from revlens.functions import text as X
from revlens.settings import LABEL_CODES
from revlens.sources.scratch import path_exists

RAW_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in ("sentimen", "kategori", "stars", "perbaikan", "textTranslated", "text")
    ]
)

PREPARED_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("kategori", T.StringType()),
        T.StructField("stars", T.StringType()),
        T.StructField("source_column", T.StringType()),
    ]
)

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# A cell of a raw sheet may hold line breaks.
RAW_CSV_OPTIONS = {**CSV_OPTIONS, "multiLine": "true"}


def require_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Fail before any job runs if a column is missing (names match exactly)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def spread(df: DataFrame, partitions: int | None, *key: str) -> DataFrame:
    """Deal an input of few file splits out to ``partitions`` tasks, if the caller
    asks for it: one Parquet row group is one task, and the text functions are
    bound by the processor. None leaves the input as it is."""
    return df if partitions is None else df.repartition(partitions, *key)


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[X.normalize_name(name) for name in df.columns])


def read_raw(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Raw review table with clean headers, from Parquet, ORC, JSON or CSV.

    For JSON and CSV give ``schema`` to spare the pass that infers one. CSV
    columns then go by position, so leave ``schema`` out if their order differs.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**RAW_CSV_OPTIONS)
    if schema is not None:
        reader = reader.schema(schema)
    return normalize_headers(reader.load(path))


def read_prepared(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(PREPARED_SCHEMA).format(fmt)
    return (reader.options(**CSV_OPTIONS) if fmt == "csv" else reader).load(path)


def labelled(df: DataFrame) -> DataFrame:
    """Training rows of a prepared table: required columns, clean text and
    labels, known labels only, no empty text. The label test comes first, so
    the text of other rows is never touched."""
    require_columns(df, ("text", "label", "label_name"))
    return (
        df.withColumn("label_name", X.normalize_label(F.col("label_name")))
        .where(F.col("label_name").isin(*LABEL_CODES))
        .withColumn("label", F.col("label").cast("int"))
        .where(X.has_text(F.col("text")))
        .withColumn("text", X.normalize_text(F.col("text")))
    )


def read_if_present(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """The table at ``path``, or an empty one."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).format(fmt)
    return (reader.options(**CSV_OPTIONS) if fmt == "csv" else reader).load(path)
