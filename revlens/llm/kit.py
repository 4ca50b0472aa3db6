"""What the operators share: reading, staging, and batches of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession

from revlens.sources.scratch import Scratch

# Working size of one step over texts; a longer single text is a step of its own.
STEP_BYTES = 4 << 20

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of each query when it has ended. Only for queries
    that write a table which is read afterwards instead of them."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 * STEP_BYTES) -> Iterator[None]:
    """Python gets batches of at most about so many bytes: a task's batch is held by
    the JVM and by its Python worker, beside each other."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


class Stage(Scratch):
    """Scratch tables whose shuffle files go when the table is written, and
    which can be deleted when their readers have finished."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._paths: dict[int, str] = {}

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        where = self.path(name)
        with freed_shuffles(self.spark):
            df.write.partitionBy(*partition_by).parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._paths[id(out)] = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            where = self._paths.pop(id(df), None)
            if where:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
                fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                fs.delete(path, True)


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``STEP_BYTES`` of text."""
    array = batch.column(column)
    if batch.num_rows == 0:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(array), 0).to_pylist()
    begin, held = 0, 0
    for row, length in enumerate(lengths):
        if held and held + length > STEP_BYTES:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += length
    yield batch.slice(begin)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
    column: str = "text",
) -> DataFrame:
    """``make()`` runs once in each task and gives the function for the steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in steps(batch, column):
                out = work(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts as Python strings; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def columns(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(values)
