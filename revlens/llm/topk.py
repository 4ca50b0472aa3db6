"""Exact top-k inner products: vectors by descending length, SVD-rotated partial
sums, and Cauchy-Schwarz bounds on what is left.

Candidates lie in shards of descending norm. A rotation, found from the Gram
matrix of all vectors, puts most of every vector's length into its first
components; a candidate is dropped when the partial product plus the product of
the remaining lengths cannot reach the k-th best score known. The longest
vectors are scored first and give every query such a score to start from.
Survivors are scored with exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from revlens.llm import kit


@dataclass(frozen=True)
class Options:
    """Sizes of the units of work; none changes the answer."""

    k: int = 5
    head: int = 2048
    shard_rows: int = 8192
    query_rows: int = 512
    step_rows: int = 512


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x, norm2) with x = floor(scale * component), of the vectors that
    take part."""
    x = F.col(vector_col)
    fine = F.forall(
        x,
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")),
    )
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return (
        df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("x"))
        .withColumn(
            "norm2",
            F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")),
        )
    )


def matrix(vectors, width: int) -> np.ndarray:
    """Rows padded with zeros to one width, as exact integers."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, by floating point where it is exact."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, longest first, from the Gram matrix:
    ``width`` squared sums, whatever the number of rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("x").to_pylist(), width).astype(np.float64)
            gram += x.T @ x
        yield kit.columns(row=np.arange(width), sums=list(gram))

    rows = vectors.select("x").mapInArrow(partial, "row bigint, sums array<double>")
    cells = rows.select("row", F.posexplode("sums").alias("column", "value"))
    summed = cells.groupBy("row", "column").agg(F.sum("value").alias("value")).toPandas()
    gram = np.zeros((width, width))
    gram[summed["row"], summed["column"]] = summed["value"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Best:
    """The k best (score, smallest id first) of each query of a block."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """The score that a candidate must reach to matter."""
        return self.score[:, -1]

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.r_[self.score[row], scores]
        ids = np.r_[self.id[row], ids]
        order = np.lexsort((ids, ~scores))[: self.k]
        self.score[row], self.id[row] = scores[order], ids[order]


def search(queries: pd.DataFrame, shard: pd.DataFrame, turn: np.ndarray, o: Options, floor=None) -> Best:
    """The best of a shard for a block of queries. ``floor``: scores that k other
    candidates are known to reach."""
    width = len(turn)
    shard = shard.sort_values("norm2", ascending=False, kind="stable")
    q = matrix(queries["x"], width)
    own = queries["vec_id"].to_numpy()
    turned = q @ turn
    lead = max(1, width // 4)
    rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
    long = np.sqrt((turned**2).sum(1))
    best = Best(len(q), o.k)
    least = np.full(len(q), np.iinfo(np.int64).min) if floor is None else floor
    for at in range(0, len(shard), o.step_rows):
        step = shard.iloc[at : at + o.step_rows]
        x = matrix(step["x"], width)
        ids = step["vec_id"].to_numpy()
        reach = long * np.sqrt(step["norm2"].iloc[0])
        slack = 1e-9 * reach + 1e-6
        bar = np.maximum(best.floor(), least).astype(np.float64)
        open_ = np.flatnonzero(reach + slack >= bar)
        if not len(open_):
            break  # every later candidate is shorter
        y = x @ turn
        bound = turned[open_, :lead] @ y[:, :lead].T
        bound += np.outer(rest[open_], np.sqrt((y[:, lead:] ** 2).sum(1)))
        may = bound + slack[open_, None] >= bar[open_, None]
        used = np.flatnonzero(may.any(0))
        exact = products(q[open_], x[used])
        for k, row in enumerate(open_):
            take = may[k, used] & (ids[used] != own[row]) & (exact[k] >= best.floor()[row])
            if take.any():
                best.add(row, exact[k, take], ids[used][take])
    return best


FOUND = "query_id bigint, vec_id bigint, score bigint"


def found_rows(queries: pd.DataFrame, best: Best) -> pd.DataFrame:
    rows = np.repeat(queries["vec_id"].to_numpy(), best.k)
    real = best.score.ravel() > np.iinfo(np.int64).min
    return pd.DataFrame(
        {"query_id": rows[real], "vec_id": best.id.ravel()[real], "score": best.score.ravel()[real]}
    )


def last_shards(queries: pd.DataFrame, floor: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """For each query the last shard whose longest vector can reach its floor, by
    Cauchy-Schwarz; ``tops``: the shards' largest lengths, descending."""
    tops = np.maximum.accumulate(tops[::-1])[::-1]
    long = np.sqrt(queries["norm2"].to_numpy(float))
    need = (floor.astype(np.float64) - 1e-6) / np.maximum(long, 1e-300) / (1 + 1e-9)
    kept = len(tops) - np.searchsorted(tops[::-1], need, "left")
    return np.maximum(np.where(long > 0, kept, len(tops)) - 1, 0).astype(np.int32)


def meetings(
    queries: DataFrame, vectors: DataFrame, shards: int
) -> tuple[DataFrame, DataFrame]:
    """Queries once for each shard that they need, and vectors once for each block
    with such a query: both sides with (block, shard), each group of bounded size."""
    needed = queries.groupBy("block").agg(F.max("last").alias("last")).toPandas()
    # Blocks 0 to upto[s] - 1 meet shard s.
    upto = np.zeros(shards, np.int64)
    np.maximum.at(upto, needed["last"].to_numpy(), needed["block"].to_numpy() + 1)
    upto = np.maximum.accumulate(upto[::-1])[::-1]
    # One row for each shard that is met.
    rows = [(s, int(n)) for s, n in enumerate(upto) if n]
    met = vectors.sparkSession.createDataFrame(rows, "shard int, upto int")
    left = queries.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"))
    right = vectors.join(F.broadcast(met), "shard").select(
        "vec_id", "x", "norm2", "shard",
        F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("block"),
    )
    return left, right


def top_k(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    options: Options = Options(),
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects
    (a condition on ``vec_id``), its k best other rows; ties go to the smaller id.

    Vectors that are null or hold a null or a non-finite component, and rows with
    a null id, take no part. Shorter vectors count as padded with zeros. Rows that
    repeat an id are candidates of their own, but not for a query of that id. No
    vectors, no rows. Other columns are left out.

    Queries and candidates meet as block by shard, each of bounded size, and only
    where the shard's longest vector can reach a query's floor.
    """
    o = options
    spark = df.sparkSession
    stage = kit.Stage(spark)
    vectors = whole_vectors(df, id_col, vector_col, scale)
    facts = vectors.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width"),
        F.count_if(is_query).alias("queries"),
    ).first()
    width = max(facts["width"], 1)
    out = T._parse_datatype_string("query_id bigint, rank int, vec_id bigint, score bigint")
    if not facts["queries"]:
        return spark.createDataFrame([], out)
    shards = -(-facts["rows"] // o.shard_rows)
    blocks = -(-facts["queries"] // o.query_rows)
    ranged = vectors.repartitionByRange(shards, F.desc("norm2"), "vec_id")
    sorted_ = stage.table(ranged.withColumn("shard", F.spark_partition_id()), "by_norm")
    turn = rotation(sorted_, width)
    head = sorted_.orderBy(F.desc("norm2"), "vec_id").limit(o.head).toPandas()
    # One number for each shard. The numbers are those of the tasks that wrote them,
    # which need not be as many as asked for, nor in order.
    longest = sorted_.groupBy("shard").agg(F.max("norm2").alias("norm2")).toPandas()
    shards = int(longest["shard"].max()) + 1
    tops = np.zeros(shards)
    tops[longest["shard"]] = np.sqrt(longest["norm2"])
    constants = spark.sparkContext.broadcast((turn, head, tops))
    queries = sorted_.where(is_query).select("vec_id", "x", "norm2")

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every query's k-th best score among the longest vectors, and the last
        shard that can reach it."""
        turn, head, tops = constants.value
        for batch in batches:
            for at in range(0, len(batch), o.query_rows):
                part = batch.iloc[at : at + o.query_rows]
                floor = search(part, head, turn, o).floor()
                yield part.assign(floor=floor, last=last_shards(part, floor, tops))

    wide = "vec_id bigint, x array<bigint>, norm2 double, floor bigint, last int"
    started = stage.table(queries.mapInPandas(start, wide), "started")
    dealt = started.repartitionByRange(blocks, F.desc("last"), "vec_id")
    dealt = stage.table(dealt.withColumn("block", F.spark_partition_id()), "queries")
    left, right = meetings(dealt, sorted_, shards)
    left, right = left.groupBy("block", "shard"), right.groupBy("block", "shard")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        turn, _, _ = constants.value
        return found_rows(left, search(left, right, turn, o, left["floor"].to_numpy()))

    found = left.cogroup(right).applyInPandas(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= o.k)
        .select("query_id", "rank", "vec_id", "score")
    )
