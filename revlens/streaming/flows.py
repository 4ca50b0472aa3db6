"""Structured Streaming forms of preparation and scoring.

Preparation without deduplication and scoring are stateless, so the batch
functions are used as they are. Deduplication keeps keys as state.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from revlens.functions import text as X
from revlens.operators.prepare import tag_rows, usable_rows
from revlens.operators.scoring import score_reviews


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "parquet",
    name_filter: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def clean_stream(raw: DataFrame) -> DataFrame:
    """Usable rows of a raw review stream, with ``digest``, duplicates included."""
    return usable_rows(tag_rows(raw))


def dedupe_stream(rows: DataFrame, event_time: str, delay: str) -> DataFrame:
    """First arrival per digest. State for a digest is dropped once the
    watermark is ``delay`` past it, so it stays bounded; a copy that comes
    later than that passes. ``rows`` must still have ``event_time``."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])


def digest_stream(raw: DataFrame, text: str = "text") -> DataFrame:
    """A stream of texts with the deduplication digest next to its columns."""
    return raw.withColumn("digest", X.key_digest(X.dedupe_key(F.col(text))))


def score_stream(reviews: DataFrame, model: PipelineModel, column: str = "text") -> DataFrame:
    return score_reviews(reviews, model, column)


def drain(
    rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Write all that is there now and stop; the next call continues from there.
    The file sink and the checkpoint together write every row once."""
    query = (
        rows.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
