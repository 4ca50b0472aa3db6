"""Substring dedup: compressed FM-indexes over shards of candidate passages.

A window of ``window`` words that occurs twice must be found wherever its copies
lie, without holding every document against every shard. Each window names an
anchor, the run of ``gram`` words in it whose hash is least, so equal windows
name equal anchors. Windows of a document that share an anchor form a segment.

1. Segments are counted by (anchor, digest). Where an anchor occurs once, nothing
   in it repeats. A segment that occurs twice or more repeats as a whole.
2. What is left are anchors with different segments around them. Each distinct
   segment goes to a shard by its anchor, with its number of copies as weight.
   The shard builds an FM-index of its segments and streams them through it:
   backward search over the wavelet tree gives the matching statistic of each
   place, and a window whose statistic reaches ``window`` repeats.
3. An anchor with very many different segments goes to no shard: its windows are
   counted by a digest of 128 bits, combined before the shuffle, and repeated
   digests are joined back block by block, so no group grows with a hot anchor.

Documents meet their marks by a key of 128 bits; texts are shuffled twice. Rows that
repeat id and text share a key: one of them stands for all where passages are cut,
and their last join is salted.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from revlens.llm import kit
from revlens.llm.fm_index import FMIndex
from revlens.llm.words import range_hash, row_keys, run_hash, words_of
from revlens.operators.skew import heavy_keys, skew_join


@dataclass(frozen=True)
class Options:
    """``window``: words that make a repeated passage. The rest are sizes of the
    units of work and change no result."""

    window: int = 35
    gram: int = 12
    shard_words: int = 60_000
    hot_segments: int = 2_000

    def __post_init__(self):
        if not 0 < self.gram <= self.window or self.window - self.gram >= 63:
            raise ValueError("1 <= gram <= window < gram + 63")


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value (the first of equals) of each ``width``
    neighbours."""
    place, held = np.arange(len(values)), 1
    while held < width:
        step = min(held, width - held)
        values_next, place_next = values[step:], place[step:]
        values, place = values[: len(values) - step], place[: len(place) - step]
        less = values_next < values
        values, place = np.where(less, values_next, values), np.where(less, place_next, place)
        held += step
    return place


def segments_of(texts: list[str], o: Options) -> dict[str, np.ndarray]:
    """anchor, digest, text number, first window, windows of each segment."""
    w = words_of(texts)
    total = len(w.hash)
    if total < o.window:
        empty = np.zeros(0, np.int64)
        return dict(anchor=empty, digest=empty, owner=empty, first=empty, n=empty)
    grams = run_hash(w.hash, o.gram)
    place = least_places(grams, o.window - o.gram + 1)
    begin = np.arange(len(place))
    whole = w.owner[begin] == w.owner[begin + o.window - 1]
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (place[1:] != place[:-1]) | (w.owner[begin[1:]] != w.owner[begin[:-1]])
    closes = whole.copy()
    closes[:-1] &= ~whole[1:] | opens[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    digest = range_hash(w.hash, first, last + o.window)
    owner = w.owner[first]
    return dict(
        anchor=grams[place[first]].view(np.int64),
        digest=digest.view(np.int64),
        owner=owner,
        first=first - w.first[owner],
        n=last - first + 1,
    )


SEGMENT = "anchor bigint, digest bigint, k1 bigint, k2 bigint, first int, n int"


def _segments(keyed: DataFrame, o: Options) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = segments_of(kit.texts_of(batch), o)
            owner = pa.array(s["owner"])
            return kit.columns(
                anchor=s["anchor"],
                digest=s["digest"],
                k1=batch.column("k1").take(owner),
                k2=batch.column("k2").take(owner),
                first=s["first"].astype(np.int32),
                n=s["n"].astype(np.int32),
            )

        return work

    return kit.map_texts(keyed, make, SEGMENT)


PASSAGE = (
    "shard int, k1 bigint, k2 bigint, first int, place int, copies bigint, words binary, "
    "block int, w1 bigint, w2 bigint"
)


def _passages(asked: DataFrame, shards: int, o: Options) -> DataFrame:
    """The words of the asked segments. Where an anchor is hot, digests (w1, w2) of
    the windows one by one, without words or shard; ``place`` is the window's
    number in its segment, and ``block`` the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.steps(batch, "text"):
                yield from _cut(part, shards, o)

    return asked.mapInArrow(run, PASSAGE)


def _cut(batch: pa.RecordBatch, shards: int, o: Options) -> Iterator[pa.RecordBatch]:
    w = words_of(kit.texts_of(batch))
    rows, block = [], TaskContext.get().partitionId()
    keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
    for text, ((k1, k2), asked) in enumerate(zip(keys, batch.column("asked").to_pylist())):
        for s in asked:
            begin = int(w.first[text]) + s["first"]
            own = (k1, k2, s["first"])
            if s["hot"]:
                for place in range(s["n"]):
                    words = b" ".join(w.slice(begin + place, begin + place + o.window))
                    digest = hashlib.blake2b(words, digest_size=16).digest()
                    halves = struct.unpack("<qq", digest)
                    rows.append((None, *own, place, s["copies"], None, block, *halves))
            else:
                words = b" ".join(w.slice(begin, begin + s["n"] + o.window - 1))
                shard = (s["anchor"] ^ (s["anchor"] >> 29)) % shards
                rows.append((shard, *own, 0, s["copies"], words, block, None, None))
        if len(rows) > 20_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    whole, half = pa.int64(), pa.int32()
    kinds = (half, whole, whole, half, half, whole, pa.binary(), half, whole, whole)
    names = ("shard", "k1", "k2", "first", "place", "copies", "words", "block", "w1", "w2")
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names
    )


MARK = "k1 bigint, k2 bigint, first int, mask bigint"


def shard_marks(table: pa.Table, o: Options) -> pa.Table:
    """The repeated windows of one shard's passages that occur once as a whole."""
    texts = table.column("words").to_pylist()
    copies = np.array(table.column("copies").to_pylist(), np.int64)
    numbers: dict[bytes, int] = {}
    lists = [
        np.array([numbers.setdefault(x, len(numbers)) for x in t.split()], np.int64) for t in texts
    ]
    index = FMIndex(lists, copies, len(numbers))
    symbols = np.concatenate(lists)
    lengths = np.array([len(x) for x in lists])
    begin = np.cumsum(lengths) - lengths
    asked = np.flatnonzero(copies == 1)
    windows = lengths[asked] - o.window + 1
    owner = np.repeat(asked, windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = begin[owner] + inside + o.window - 1
    repeated = index.matches(symbols, ends, o.window, 2) >= o.window
    place = np.array(table.column("place").to_pylist(), np.int64)
    bits = np.int64(1) << (inside + place[owner])
    masks = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(masks, owner[repeated], bits[repeated])
    found = np.flatnonzero(masks)
    out = table.select(["k1", "k2", "first"]).take(found)
    return out.append_column("mask", pa.array(masks[found]))


def hot_marks(windows: DataFrame) -> DataFrame:
    """The repeated windows of hot anchors in segments that occur once. Equal
    windows all lie at one anchor, so a digest's copies are all there are."""
    counts = windows.groupBy("w1", "w2", "block").agg(F.sum("copies").alias("copies"))
    many = counts.groupBy("w1", "w2").agg(F.sum("copies").alias("all")).where("all > 1")
    # Blocks tell a key's rows apart, so the join meets at most one block's at once.
    repeated = counts.join(many.select("w1", "w2"), ["w1", "w2"]).select("w1", "w2", "block")
    found = windows.where("copies = 1").join(repeated, ["w1", "w2", "block"])
    mask = F.expr("bit_or(shiftleft(1L, place))").alias("mask")
    return found.groupBy("k1", "k2", "first").agg(mask)


def covered(first: list[int], masks: list[int], words: int, window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    change = np.zeros(words + 1, np.int64)
    for begin, mask in zip(first, masks):
        at = begin
        while mask:
            if mask & 1:
                change[at] += 1
                change[at + window] -= 1
            mask >>= 1
            at += 1
    return change[:-1].cumsum() > 0


def repeated_windows(keyed: DataFrame, stage: kit.Stage, o: Options) -> DataFrame:
    """(k1, k2, first, mask) of the repeated windows of rows (k1, k2, text): bit
    k of a mask stands for the window that starts at word first + k."""
    segments = _segments(keyed, o)
    kinds = segments.groupBy("anchor", "digest").agg(F.count("*").alias("copies"))
    anchors = (
        kinds.groupBy("anchor")
        .agg(F.sum("copies").alias("all"), F.count("*").alias("kinds"))
        .where("all > 1")
        .select("anchor", "kinds")
    )
    shared = stage.table(kinds.join(anchors, "anchor"), "shared_anchors")
    placed = stage.table(segments.join(shared, ["anchor", "digest"]), "shared_segments")
    stage.drop(shared)

    whole = placed.where("copies > 1").select(
        "k1", "k2", "first", F.expr("shiftleft(1L, n) - 1 AS mask")
    )
    mixed = placed.where("kinds > 1")
    one_each = mixed.where("copies > 1").dropDuplicates(["anchor", "digest"])
    asked = mixed.where("copies = 1").unionByName(one_each)
    words = asked.agg(F.sum(F.col("n") + (o.window - 1))).first()[0] or 0
    if not words:
        return stage.table(whole, "marks")
    shards = -(-words // o.shard_words)
    by_text = asked.groupBy("k1", "k2").agg(
        F.collect_list(
            F.struct("anchor", "first", "n", "copies", (F.col("kinds") > o.hot_segments).alias("hot"))
        ).alias("asked")
    )
    # One of the rows that repeat id and text stands for all, combined before the shuffle.
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    passages = stage.table(_passages(texts.join(by_text, ["k1", "k2"]), shards, o), "passages")
    in_shards = passages.where("shard IS NOT NULL").drop("block", "w1", "w2")
    found = in_shards.groupBy("shard").applyInArrow(lambda t: shard_marks(t, o), MARK)
    hot = hot_marks(passages.where("shard IS NULL").drop("shard", "words"))
    marks = stage.table(whole.unionByName(found).unionByName(hot), "marks")
    stage.drop(placed, passages)
    return marks


def _fresh(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def remove_repeats(
    df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, n_words, n_removed, kept): each row as a struct with all its columns,
    and its text without the words of repeated windows, joined by one space.

    A window repeats if its words start anywhere else, in the same document too;
    all windows are judged on the input. A null or empty text has no words; so has
    no text shorter than a window anything to remove. Rows that repeat id and text
    are documents of their own and make each other's windows repeat. Texts of any
    length are judged whole.
    """
    o = options
    stage = kit.Stage(df.sparkSession)
    k1, k2 = row_keys(df, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"), F.struct("*").alias("row"))
    marks = repeated_windows(rows.select("k1", "k2", "text"), stage, o)
    # Rows that repeat id and text have the same marks, of which a set keeps one
    # before the shuffle. The rows themselves are split over tasks by where they
    # are read.
    by_text = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    key = ["k1", "k2"]
    joined = skew_join(
        rows.withColumn("part", F.spark_partition_id()),
        by_text,
        key,
        F.col("part"),
        how="left",
        heavy=heavy_keys(rows.select(*key), key),
    ).drop("part", *key)
    fields = joined.select("row").schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.steps(batch, "text"):
                counts, removed, kept = [], [], []
                for t, m in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                    words = t.encode("utf-8", "surrogatepass").split()
                    counts.append(len(words))
                    if not m:
                        removed.append(0)
                        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                        continue
                    gone = covered([x["first"] for x in m], [x["mask"] for x in m], len(words), o.window)
                    removed.append(int(gone.sum()))
                    left = [words[k] for k in np.flatnonzero(~gone)]
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                yield kit.columns(
                    row=part.column("row"),
                    n_words=pa.array(counts, pa.int64()),
                    n_removed=pa.array(removed, pa.int64()),
                    kept=pa.array(kept, pa.string()),
                )

    return joined.mapInArrow(run, f"row {fields}, n_words bigint, n_removed bigint, kept string")


def without_repeats(
    df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns; a text that loses words becomes its kept words,
    joined by one space, and any other text stays as it is."""
    found = remove_repeats(df, options, id_col, text_col)
    return found.select(
        *[
            F.when(F.col("n_removed") > 0, F.col("kept"))
            .otherwise(F.col(f"row.`{c}`"))
            .alias(c)
            if c == text_col
            else F.col(f"row.`{c}`").alias(c)
            for c in df.columns
        ]
    )
