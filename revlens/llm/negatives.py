"""Hard-negative mining with bounds along a spanning tree of the anchors.

The anchors of a block are joined by a minimum spanning tree. A candidate's score
at a child differs from its score at the parent by at most the length of the edge
times the candidate's norm, so walking the tree from its root carries an interval
for every candidate from anchor to anchor. Only candidates whose interval
overlaps what an anchor still looks for are scored, and their interval shrinks to
a point. Scores are exact integers.

First every anchor finds its positives among the rows of its label, then its
negatives inside the windows that the positives' scores set. Blocks of anchors
meet shards of candidates; before any vector moves, the pairs are dropped whose
labels do not meet, or whose scores cannot reach a window of the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm import kit
from revlens.llm.topk import products


@dataclass(frozen=True)
class Options:
    """``low`` and ``high``: the window, in hundredths of the positive's score. The
    rest are sizes of the units of work; none changes the answer."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    block_anchors: int = 256
    shard_rows: int = 8192
    pivots: int = 64
    blocks_at_once: int = 4096


def taking_part(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, x) with x = floor(scale * component), of the rows that
    take part."""
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return named.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.coalesce(finite, F.lit(False))
    ).select("vec_id", "label", whole.alias("x"))


def dense(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of one width, shorter ones padded with zeros."""
    parts = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    out = [np.zeros((0, width), np.int64)]
    for part in parts:
        sizes = np.diff(part.offsets.to_numpy())
        rows = np.zeros((len(sizes), width), np.int64)
        rows[np.arange(width) < sizes[:, None]] = part.flatten().to_numpy()
        out.append(rows)
    return np.concatenate(out)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree of the rows: an order in which parents precede
    their children, each row's parent (-1 for the root) and the edge to it. The
    root is the row nearest to the mean."""
    x = x.astype(np.float64)
    n = len(x)
    root = int(lengths(x - x.mean(0)).argmin())
    order, parent, edge = [root], np.full(n, -1), np.zeros(n)
    near = lengths(x - x[root])
    via = np.full(n, root)
    near[root] = np.inf
    for _ in range(n - 1):
        k = int(near.argmin())
        order.append(k)
        parent[k], edge[k] = via[k], near[k]
        away = lengths(x - x[k])
        closer = (away < near) & (near < np.inf)
        near[closer], via[closer] = away[closer], k
        near[k] = np.inf
    return np.array(order), parent, edge


def walk(
    anchors: np.ndarray,
    parent: np.ndarray,
    edge: np.ndarray,
    candidates: np.ndarray,
    wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, exact scores) for each anchor, parents first.
    ``wanted(anchor, low, high)`` tells which candidates may matter when their
    scores lie in these intervals."""
    norm, reach = lengths(candidates), lengths(anchors)
    low = np.empty((len(anchors), len(candidates)))
    high = np.empty_like(low)
    for a in range(len(anchors)):
        longest = reach[a] * norm
        slack = 1e-9 * longest + 1e-6
        if parent[a] < 0:
            low[a], high[a] = -longest - slack, longest + slack
            need = np.arange(len(candidates))
        else:
            wide = edge[a] * norm + slack
            low[a] = np.maximum(low[parent[a]] - wide, -longest - slack)
            high[a] = np.minimum(high[parent[a]] + wide, longest + slack)
            need = np.flatnonzero(wanted(a, low[a], high[a]))
        scores = products(anchors[a : a + 1], candidates[need])[0]
        low[a, need] = high[a, need] = scores
        yield a, need, scores


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores; ties go to the smaller id."""
    return np.lexsort((rows, ids, -scores))[:k]


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


@dataclass
class Meeting:
    """A block of anchors, in the order of its tree, and a shard of candidates."""

    block: pd.DataFrame
    anchors: np.ndarray
    candidates: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, left: pa.Table, right: pa.Table, width: int) -> Meeting:
        left = left.sort_by("at")
        return cls(
            left.drop_columns(["x"]).to_pandas(),
            dense(left.column("x"), width),
            dense(right.column("x"), width),
            right.column("vec_id").to_numpy(),
            right.column("row").to_numpy(),
            right.column("label").to_numpy(),
        )

    def walk(self, wanted):
        parent, edge = self.block["parent"].to_numpy(), self.block["edge"].to_numpy()
        return walk(self.anchors, parent, edge, self.candidates, wanted)

    def positives(self, k: int) -> pd.DataFrame:
        own, labels = self.block["row"].to_numpy(), self.block["label"].to_numpy()

        def mine(a: int) -> np.ndarray:
            return (self.labels == labels[a]) & (self.rows != own[a])

        def wanted(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            possible = mine(a)
            return possible & (high >= kth_largest(low[possible], k))

        out = []
        for a, need, scores in self.walk(wanted):
            need, scores = need[keep := mine(a)[need]], scores[keep]
            top = best_of(scores, self.ids[need], self.rows[need], k)
            out.append(
                pd.DataFrame(
                    {"anchor": own[a], "vec_id": self.ids[need[top]], "row": self.rows[need[top]],
                     "score": scores[top]}
                )
            )
        return pd.concat(out)

    def negatives(self, o: Options) -> pd.DataFrame:
        own, labels = self.block["row"].to_numpy(), self.block["label"].to_numpy()
        windows = [[(int(w["place"]), int(w["score"])) for w in ws] for ws in self.block["windows"]]

        def wanted(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            other = self.labels != labels[a]
            need = np.zeros(len(other), bool)
            for _, score in windows[a]:
                least, most = o.low * score / 100, o.high * score / 100
                may = other & (high >= least) & (low <= most)
                # So many surely lie inside with at least this score.
                floor = kth_largest(low[other & (low >= least) & (high <= most)], o.negatives)
                need |= may & (high >= floor)
            return need

        out = []
        for a, need, scores in self.walk(wanted):
            need, scores = need[other := self.labels[need] != labels[a]], scores[other]
            for place, score in windows[a]:
                inside = (100 * scores >= o.low * score) & (100 * scores <= o.high * score)
                at, found = need[inside], scores[inside]
                top = best_of(found, self.ids[at], self.rows[at], o.negatives)
                out.append(
                    pd.DataFrame(
                        {"anchor": own[a], "place": place, "vec_id": self.ids[at[top]],
                         "row": self.rows[at[top]], "score": found[top]}
                    )
                )
        return pd.concat(out) if out else pd.DataFrame()


def _meet(anchors, vectors, pairs, width, schema, work) -> DataFrame:
    """``work`` on every (block, shard) of ``pairs``; both sides are bounded."""
    by_block = pairs.groupBy("block").agg(F.collect_list("shard").alias("shards"))
    by_shard = pairs.groupBy("shard").agg(F.collect_list("block").alias("blocks"))
    left = anchors.join(by_block, "block").withColumn("shard", F.explode("shards")).drop("shards")
    right = vectors.join(by_shard, "shard").withColumn("block", F.explode("blocks")).drop("blocks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = pd.DataFrame()
        if left.num_rows and right.num_rows:
            found = work(Meeting.of(left, right, width))
        names = [field.split()[0] for field in schema.split(", ")]
        return pa.table(
            {n: pa.array(found[n] if len(found) else [], pa.int64()) for n in names}
        )

    keys = ("block", "shard")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _ranked(found: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    options: Options = Options(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that ``is_anchor`` (a condition on ``vec_id``) selects.
    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Shorter vectors count as padded with zeros, so an empty one is
    all zeros. A row is never its own positive; rows that repeat an id are rows
    of their own. Ties go to the smaller id. A positive without negatives, and an
    anchor without positives, has no rows. Labels are integers. Other columns are
    left out. Scores must fit 64 bits, and a task must hold a shard of vectors.
    """
    o = options
    spark = df.sparkSession
    stage = kit.Stage(spark)
    label = F.col("label") if label is None else label
    taken = taking_part(df, id_col, vector_col, label.cast("long"), scale)
    taken = stage.table(taken.withColumn("row", F.monotonically_increasing_id()), "vectors")
    facts = taken.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width"),
        F.count_if(is_anchor).alias("anchors"),
    ).first()
    width = max(facts.width, 1)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not facts.anchors:
        return spark.createDataFrame([], out)

    # A bounded sample of places; every row belongs to its nearest one.
    drawn = taken.orderBy(F.xxhash64("row")).select("x").limit(o.pivots).toArrow()
    pivots = spark.sparkContext.broadcast(dense(drawn.column("x"), width))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("x"), width).astype(np.float64)
            p = pivots.value.astype(np.float64)
            pivot = ((p**2).sum(1) - 2 * x @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot, pa.int32()), pa.array(lengths(x - p[pivot])), pa.array(lengths(x))],
                [*batch.schema.names, "pivot", "away", "norm"],
            )

    placed = "vec_id bigint, label bigint, x array<bigint>, row bigint, pivot int, away double, norm double"
    near = taken.mapInArrow(nearest, placed)
    layout = ("label", "pivot", "vec_id", "row")

    def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
        """Neighbours in runs of about one size, however many partitions hold them."""
        parts = max(1, size)
        ranged = rows.repartitionByRange(parts, *layout).withColumn("part", F.spark_partition_id())
        ranged = stage.table(ranged, name)
        there = max(ranged.agg(F.max("part")).first()[0] + 1, parts)
        number = F.floor(F.col("part") * parts / F.lit(there)).cast("int")
        return ranged.withColumn(name, number).drop("part")

    shards = dealt(near, -(-facts.rows // o.shard_rows), "shard")
    blocks = dealt(near.where(is_anchor), -(-facts.anchors // o.block_anchors), "block")

    def grow(block: pa.Table) -> pa.Table:
        x = dense(block.column("x"), width)
        order, parent, edge = spanning_tree(x)
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        reach = float(lengths(x - x[order[0]]).max())
        new = {
            "at": pa.array(at, pa.int64()),
            "parent": pa.array(np.where(parent >= 0, at[parent], -1), pa.int64()),
            "edge": pa.array(edge),
            "reach": pa.array(np.full(len(x), reach)),
        }
        kept = {n: block.column(n) for n in ("block", "vec_id", "row", "label", "x")}
        return pa.table(kept | new)

    tree = "block int, vec_id bigint, row bigint, label bigint, x array<bigint>, at bigint, parent bigint, edge double, reach double"
    anchors = stage.table(blocks.groupBy("block").applyInArrow(grow, tree), "anchors")

    # What is known of each part of a shard without its vectors.
    parts = shards.groupBy("shard", "pivot").agg(
        F.max("away").alias("away"),
        F.max("norm").alias("norm"),
        F.min("label").alias("first_label"),
        F.max("label").alias("last_label"),
    )
    parts = stage.table(parts, "parts")

    def pairs(of_blocks: DataFrame, keep, name: str) -> DataFrame:
        """(block, shard) for which ``keep(blocks, parts)`` holds; the blocks are
        looked at in runs of bounded size."""
        total = anchors.agg(F.max("block")).first()[0] + 1
        found = None
        for first in range(0, total, o.blocks_at_once):
            run = (F.col("block") >= first) & (F.col("block") < first + o.blocks_at_once)
            some = spark.sparkContext.broadcast(of_blocks.where(run).toPandas())

            def meet(batches: Iterator[pd.DataFrame], some=some) -> Iterator[pd.DataFrame]:
                for part in batches:
                    shard, block = np.nonzero(keep(some.value, part))
                    yield pd.DataFrame(
                        {"block": some.value["block"].to_numpy()[block], "shard": part["shard"].to_numpy()[shard]}
                    )

            more = parts.mapInPandas(meet, "block int, shard int")
            found = more if found is None else found.unionByName(more)
        return stage.table(found.distinct(), name)

    spans = F.min("label").alias("first_label"), F.max("label").alias("last_label")

    def same_label(blocks: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
        first, last = (blocks[n].to_numpy() for n in ("first_label", "last_label"))
        return (part["first_label"].to_numpy()[:, None] <= last) & (part["last_label"].to_numpy()[:, None] >= first)

    meeting = pairs(anchors.groupBy("block").agg(*spans), same_label, "label_pairs")
    found = _meet(
        anchors, shards.select("shard", "vec_id", "label", "x", "row"), meeting, width,
        "anchor bigint, vec_id bigint, row bigint, score bigint",
        lambda m: m.positives(o.positives),
    )
    positives = stage.table(_ranked(found, ("anchor",), o.positives), "positives")

    # At most ``positives`` windows for each anchor.
    windows = positives.groupBy("anchor").agg(F.collect_list(F.struct("place", "score")).alias("windows"))
    none = F.array().cast("array<struct<place:bigint,score:bigint>>")
    armed = anchors.join(windows, F.col("row") == F.col("anchor"), "left").drop("anchor")
    armed = stage.table(armed.withColumn("windows", F.coalesce("windows", none)), "armed")
    scores = F.col("windows")["score"]
    facts_of_blocks = armed.groupBy("block").agg(
        *spans,
        F.min_by("x", "at").alias("root"),
        F.max("reach").alias("reach"),
        F.min(F.array_min(scores)).alias("least"),
        F.max(F.array_max(scores)).alias("most"),
    )

    def overlapping(blocks: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
        """Scores of the block's anchors over the part: those of the root at the
        pivot, give or take what the distances allow."""
        root = np.zeros((len(blocks), width))
        for k, x in enumerate(blocks["root"]):
            root[k, : len(x)] = x
        pivot = pivots.value[part["pivot"].to_numpy()].astype(np.float64)
        away, norm = (part[n].to_numpy()[:, None] for n in ("away", "norm"))
        middle = pivot @ root.T
        spread = away * lengths(root) + norm * blocks["reach"].to_numpy()
        spread += 1e-9 * np.abs(middle) + 1e-9 * spread + 1e-6
        # Windows of negative scores are empty, so they reach from 0 at least.
        least = o.low * np.maximum(blocks["least"].to_numpy(np.float64), 0) / 100
        most = o.high * blocks["most"].to_numpy(np.float64) / 100
        labels = [(f[n].to_numpy()) for f in (part, blocks) for n in ("first_label", "last_label")]
        one = (labels[0][:, None] == labels[3]) & (labels[1][:, None] == labels[2])
        with np.errstate(invalid="ignore"):
            return (middle + spread >= least) & (middle - spread <= most) & ~one

    meeting = pairs(facts_of_blocks, overlapping, "window_pairs")
    found = _meet(
        armed, shards.select("shard", "vec_id", "label", "x", "row"), meeting, width,
        "anchor bigint, place bigint, vec_id bigint, row bigint, score bigint",
        lambda m: m.negatives(o),
    )
    found = found.withColumnRenamed("place", "positive")
    ranked = _ranked(found, ("anchor", "positive"), o.negatives).select(
        "anchor", "positive", F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    named = positives.select(
        "anchor", F.col("place").alias("positive"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        ranked.join(named, ["anchor", "positive"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
