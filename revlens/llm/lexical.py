"""Ranked lexical search by the Best Position Algorithm.

One pass over the texts keeps, of each document, its length and the counts of
the terms that the items ask for, and adds up the document frequencies. A second
pass over these rows cuts them into shards. Within a shard every term has an
impact list, longest impact first, that is read by sorted access; each document
found is scored by direct accesses to the item's other lists, which mark its
positions there as seen. The best position of a list is the end of its leading
run of seen positions. No unseen document can score more than the sum of the
impacts at the best positions, so reading ends when this sum is strictly below
the k-th score; documents that tie with it are found, and the smaller id wins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window

from revlens.llm import kit

# A term is a run of ASCII letters, digits and bytes of other characters.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a whole text, in order; A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Options:
    """Sizes of the units of work (``block_bytes`` and ``block_items`` bound what
    is broadcast at once); none changes the answer."""

    k: int = 20
    block_bytes: int = 8 << 20
    block_items: int = 20_000
    shard_postings: int = 1 << 20
    first_depth: int = 64


def weight(n_docs: int, df: int) -> int:
    """The weight of a term, never below 0 since df is at most n_docs."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 for a document of average length."""
    return 100 - 25 + (25 * n * n_docs) // max(n_terms, 1)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """At most a million, however often a term stands in a document."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """The impact lists of some documents, in two orders: by impact for sorted
    access, and by document for direct access."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.n_docs = n_docs
        direct = np.argsort(term, kind="stable")  # documents ascend within a term
        self.direct_doc, self.direct_impact = doc[direct], impact[direct]
        term = term[direct]
        order = np.lexsort((-self.direct_impact, term))
        self.doc, self.impact = self.direct_doc[order], self.direct_impact[order]
        self.names, self.first, counts = np.unique(term, return_index=True, return_counts=True)
        self.end = self.first + counts
        self.position = np.empty(len(term), np.int64)
        self.position[order] = np.arange(len(term)) - np.repeat(self.first, counts)

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted terms have a list here, and the lists' numbers."""
        at = np.searchsorted(self.names, wanted)
        at[at == len(self.names)] = 0
        here = np.flatnonzero(self.names[at] == wanted) if len(self.names) else np.zeros(0, np.int64)
        return here, at[here]


def best_positions(
    shard: Shard, term: np.ndarray, times: np.ndarray, k: int, floor: int, depth: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of every document of the shard that may be among the
    k best, and how many positions were read. ``floor``: a score that k other
    documents are known to reach."""
    here, number = shard.lists(term)
    times = times[here]
    first, end = shard.first[number], shard.end[number]
    size = end - first
    marks = [np.zeros(n, bool) for n in size]
    best = np.zeros(len(size), np.int64)
    seen = np.zeros(shard.n_docs, bool)
    docs, scores = [], []
    read, kth = 0, floor
    while (best < size).any():
        upto = np.minimum(read + depth, size)
        parts = [shard.doc[f + read : f + u] for f, u in zip(first, upto) if u > read]
        found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        found = found[~seen[found]]
        seen[found] = True
        score = np.zeros(len(found), np.int64)
        for j in range(len(size)):
            marks[j][read : upto[j]] = True
            own = shard.direct_doc[first[j] : end[j]]
            at = np.searchsorted(own, found)
            at[at == len(own)] = 0
            hit = own[at] == found
            at = at[hit] + first[j]
            score[hit] += times[j] * shard.direct_impact[at]
            marks[j][shard.position[at]] = True
        docs.append(found)
        scores.append(score)
        read, depth = read + depth, depth * 2
        for j in range(len(size)):
            unseen = np.flatnonzero(~marks[j][best[j] :])
            best[j] = best[j] + unseen[0] if len(unseen) else size[j]
        every = np.concatenate(scores)
        if len(every) >= k:
            kth = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
        elif floor <= 0:
            continue
        open_ = best < size  # a list seen to its end has no unseen documents
        last = shard.impact[first[open_] + np.maximum(best[open_] - 1, 0)]
        if int((times[open_] * last).sum()) < kth:
            break
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    docs, scores = np.concatenate(docs), np.concatenate(scores)
    may = (scores >= kth) & (scores > 0)
    return docs[may], scores[may], int(np.minimum(read, size).sum())


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)


@dataclass
class Block:
    """Items with their term numbers and how often each term stands in them."""

    vocabulary: dict[bytes, int]
    queries: list[tuple[str, np.ndarray, np.ndarray]]


def _block(rows) -> Block:
    vocabulary: dict[bytes, int] = {}
    queries = []
    for r in rows:
        counts = Counter(terms(r.text.encode()))
        numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
        queries.append((r.key, np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))
    return Block(vocabulary, queries)


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, terms, counts) of each document with a wanted term; and for each
    task one row with ``docs``, the number of its documents with any term, in
    which n is their length and counts are document frequencies."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        df: Counter = Counter()
        n_docs = n_terms = 0
        id_type = None

        def rows(ids, n, found, docs=None) -> pa.RecordBatch:
            return kit.columns(
                id=ids,
                n=pa.array(n, pa.int64()),
                terms=pa.array([list(c) for c in found], pa.list_(pa.int32())),
                counts=pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                docs=pa.array([docs] * len(n), pa.int64()),
            )

        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in kit.steps(batch, "text"):
                keep, lengths, found = [], [], []
                for row, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    words = terms(text)
                    n_docs += bool(words)
                    n_terms += len(words)
                    counts = Counter(map(get, words))
                    counts.pop(None, None)
                    if counts:
                        df.update(counts.keys())
                        keep.append(row)
                        lengths.append(len(words))
                        found.append(counts)
                if keep:
                    yield rows(part.column("id").take(pa.array(keep)), lengths, found)
        if n_docs:
            yield rows(pa.nulls(1, id_type), [n_terms], [df], n_docs)

    return docs.mapInArrow(
        run, f"id {kind}, n bigint, terms array<int>, counts array<bigint>, docs bigint"
    )


def _search(found: DataFrame, constants, o: Options) -> DataFrame:
    """Each task's k best documents of every query: (query, id, score)."""
    kind = found.schema["id"].dataType.simpleString()

    def shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pa.compute.list_value_length(batch.column("terms")).to_numpy()
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, before + o.shard_postings, "right")))
            yield batch.slice(at, upto - at)
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_terms = constants.value
        top: list[list[tuple]] = [[] for _ in queries]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in shards(batch):
                term, sizes = _lists(part.column("terms"))
                counts, _ = _lists(part.column("counts"))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                m = length_part(part.column("n").to_numpy(), n_docs, n_terms)
                impact = weights[term] * saturation(counts, m[doc])
                shard = Shard(term.astype(np.int64), doc, impact, len(sizes))
                ids = part.column("id").to_pylist()
                for held, (_, wanted, times) in zip(top, queries):
                    floor = -held[-1][0] if len(held) == o.k else 0
                    at, score, _ = best_positions(shard, wanted, times, o.k, floor, o.first_depth)
                    if not len(at):
                        continue
                    held += [
                        (-s, ids[d] is None, 0 if ids[d] is None else ids[d])
                        for d, s in zip(at.tolist(), score.tolist())
                    ]
                    held.sort()
                    del held[o.k :]
        rows = [(q[0], *r) for q, held in zip(queries, top) for r in held]
        if rows:
            yield kit.columns(
                query=pa.array([r[0] for r in rows], pa.string()),
                id=pa.array([None if r[2] else r[3] for r in rows], id_type),
                score=pa.array([-r[1] for r in rows], pa.int64()),
            )

    return found.mapInArrow(run, f"query string, id {kind}, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    options: Options = Options(),
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of score above
    0, equal scores by the smaller id (null last).

    Whole texts count; null has no terms. Items of equal text are searched once
    and answered each; items without a known term have no rows. Documents that
    repeat an id are ranked on their own, in equal places. Without documents or
    items there are no rows. Other columns are left out. Ids are numbers, or any
    type of one order.

    Distinct item texts are searched in blocks of bounded size, and each block
    reads the documents once; documents do not move.
    """
    o = options
    spark = docs.sparkSession
    stage = kit.Stage(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.where(F.col(text_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), F.sha2(text_col, 256).alias("query")
    )
    distinct = stage.table(asked.groupBy("query").agg(F.first("text").alias("text")), "queries")
    size = distinct.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-size.n // o.block_items), -(-(size.bytes or 0) // o.block_bytes))
    id_kind = docs.schema[id_col].dataType
    item_kind = items.schema[item_col].dataType
    out = T.StructType(
        [
            T.StructField("item_id", item_kind),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", id_kind),
            T.StructField("score", T.LongType()),
        ]
    )
    answers = spark.createDataFrame([], out)
    block_of = F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1)))
    for number in range(blocks):
        rows = distinct.where(block_of == number).select(F.col("query").alias("key"), "text").collect()
        block = _block(rows)
        words = spark.sparkContext.broadcast(block.vocabulary)
        found = stage.table(postings(texts, words), "postings")
        sums = found.where(F.col("docs").isNotNull())
        n_docs, n_terms = sums.agg(F.sum("docs"), F.sum("n")).first()
        if not n_docs:
            continue
        # One row for each term of the block at most.
        pairs = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("df")))
        df = sums.select(pairs).groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = np.zeros(len(block.vocabulary) + 1, np.int64)
        for r in df:
            weights[r.term] = weight(n_docs, r.df)
        constants = spark.sparkContext.broadcast((block.queries, weights, n_docs, n_terms))
        best = _search(found.where(F.col("docs").isNull()), constants, o)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= o.k)
        # k rows for each distinct text of the block.
        joined = asked.join(F.broadcast(best), "query")
        answers = answers.unionByName(
            joined.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        )
    return answers
