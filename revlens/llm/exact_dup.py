"""Exact deduplication by a cuckoo-filter index of live digests.

Every text becomes the SHA-256 of its characters without blanks. The digests lie
in shards, and each shard keeps a cuckoo filter: 16-bit fingerprints in buckets
of four slots. A fingerprint that is not found proves a digest new; a hit is
verified against the full digests that the bucket's slots hold. An insertion
that finds no room doubles the filter and fills it anew from the stored digests.
Digests leave the filter when their last row is deleted.

The index is a table with one row for each live digest: its shard, its slot, the
number of its rows and the row that stays. Later batches of rows are inserted
into, or deleted from, such a table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm import kit

BLANKS = bytes([0x20, *range(0x09, 0x0E)])

SLOTS = 4
MOST_KICKS = 500
FULL = 0.9


@dataclass(frozen=True)
class Options:
    """Sizes of the units of work; none changes the answer."""

    shard_keys: int = 2048
    combine_keys: int = 65_536
    broadcast_groups: int = 100_000


class CuckooFilter:
    """Fingerprints with, for each, the number of its key; the keys are kept for
    verifying hits and for resizing."""

    def __init__(self, expected: int = 0):
        self.buckets = 16
        while self.buckets * SLOTS * FULL < expected:
            self.buckets *= 2
        self.keys: list[bytes | None] = []
        self.resized = 0
        self._clear()

    @classmethod
    def restore(cls, buckets: int, slots: list[int], keys: list[bytes]) -> CuckooFilter:
        out = cls()
        out.buckets = buckets
        out.keys = list(keys)
        out._clear()
        for number, (slot, key) in enumerate(zip(slots, keys)):
            out.prints[slot], out.owner[slot] = out._places(key)[0], number
        return out

    def _clear(self) -> None:
        self.prints = [0] * (self.buckets * SLOTS)
        self.owner = [-1] * (self.buckets * SLOTS)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995 >> 4)) & (self.buckets - 1)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """The fingerprint and both buckets; zero means an empty slot."""
        bits = int.from_bytes(key[:8], "little")
        fingerprint = (bits >> 48) or 1
        bucket = bits & (self.buckets - 1)
        return fingerprint, bucket, self._other(bucket, fingerprint)

    def _slot(self, key: bytes) -> int:
        fingerprint, one, two = self._places(key)
        prints = self.prints
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[slot] == fingerprint and self.keys[self.owner[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """The number of a live key, or -1."""
        slot = self._slot(key)
        return self.owner[slot] if slot >= 0 else -1

    def add(self, key: bytes) -> int:
        """Insert a key that is not live; its number."""
        number = len(self.keys)
        self.keys.append(key)
        if not self._insert(number):
            self._resize()
        return number

    def remove(self, key: bytes) -> None:
        slot = self._slot(key)
        if slot >= 0:
            self.keys[self.owner[slot]] = None
            self.prints[slot], self.owner[slot] = 0, -1

    def live(self) -> Iterator[tuple[int, int]]:
        """(slot, key number) of all live keys."""
        return ((slot, number) for slot, number in enumerate(self.owner) if number >= 0)

    def _insert(self, number: int) -> bool:
        fingerprint, bucket, two = self._places(self.keys[number])
        for place in (bucket, two):
            for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.owner[slot] = fingerprint, number
                    return True
        bucket = two
        for kick in range(MOST_KICKS):
            slot = bucket * SLOTS + (number + kick) % SLOTS
            self.prints[slot], fingerprint = fingerprint, self.prints[slot]
            self.owner[slot], number = number, self.owner[slot]
            bucket = self._other(bucket, fingerprint)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.owner[slot] = fingerprint, number
                    return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled from the stored keys; again if need be."""
        while True:
            self.buckets *= 2
            self.resized += 1
            self._clear()
            if all(self._insert(n) for n, key in enumerate(self.keys) if key is not None):
                return


class Live:
    """The live digests of a shard, or of a part of a task's rows."""

    def __init__(self, found: CuckooFilter | None = None):
        self.filter = found or CuckooFilter()
        self.rows: list[int] = []
        self.best: list[tuple | None] = []

    def insert(self, digest: bytes, rows: int, best: tuple | None) -> None:
        key = self.filter.find(digest)
        if key < 0:
            self.filter.add(digest)
            self.rows.append(rows)
            self.best.append(best)
            return
        self.rows[key] += rows
        old = self.best[key]
        if old is not None:  # otherwise it is looked for again, among all rows
            self.best[key] = best if best is not None and best < old else old

    def delete(self, digest: bytes, rows: int, best: tuple) -> None:
        key = self.filter.find(digest)
        if key < 0:
            return
        self.rows[key] -= rows
        if self.rows[key] <= 0:
            self.filter.remove(digest)
        elif self.best[key] is not None and best <= self.best[key]:
            self.best[key] = None


def _order(n_chars: int | None, id_, row: int) -> tuple | None:
    """The smallest is the row that stays: most characters, then smallest id
    (null last), then the row number."""
    if row is None:
        return None
    return (-n_chars, id_ is None, 0 if id_ is None else id_, row)


def _columns(best: list[tuple | None], id_type: pa.DataType) -> dict[str, pa.Array]:
    return {
        "n_chars": pa.array([None if b is None else -b[0] for b in best], pa.int64()),
        "id": pa.array([None if b is None or b[1] else b[2] for b in best], id_type),
        "row": pa.array([None if b is None else b[3] for b in best], pa.int64()),
    }


def _entries(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[bytes, int, tuple | None]]:
    names = ("digest", "rows", "n_chars", "id", "row")
    for digest, rows, *best in zip(*(table.column(n).to_pylist() for n in names)):
        yield digest, rows, _order(*best)


def digest(text: bytes | None) -> bytes:
    return hashlib.sha256((text or b"").translate(None, BLANKS)).digest()


def rows_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_chars, row): what the index needs of each row. ``row`` tells
    rows apart; write the table before using it twice."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = batch.column("text")
            lengths = pa.compute.fill_null(pa.compute.utf8_length(text), 0)
            found = [digest(t) for t in text.cast(pa.binary()).to_pylist()]
            return kit.columns(
                id=batch.column("id"),
                digest=pa.array(found, pa.binary()),
                n_chars=lengths.cast(pa.int64()),
            )

        return work

    out = kit.map_texts(texts, make, f"id {kind}, digest binary, n_chars bigint")
    own = F.xxhash64(F.lit(uuid.uuid4().hex), F.monotonically_increasing_id())
    return out.withColumn("row", own)


def _changes(rows: DataFrame, shard: Column, o: Options) -> DataFrame:
    """(shard, digest, rows, n_chars, id, row): equal digests of a task are
    combined before they move, so that a hot text is few rows."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("id", "digest", "n_chars", "row", shard.alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shards, id_type = Live(), [], None

        def flush() -> pa.RecordBatch:
            return kit.columns(
                shard=pa.array(shards, pa.int32()),
                digest=pa.array(held.filter.keys, pa.binary()),
                rows=pa.array(held.rows, pa.int64()),
                **_columns(held.best, id_type),
            )

        for batch in batches:
            id_type = batch.schema.field("id").type
            names = ("digest", "n_chars", "id", "row", "shard")
            for key, *best, at in zip(*(batch.column(n).to_pylist() for n in names)):
                held.insert(key, 1, _order(*best))
                if len(held.rows) > len(shards):
                    shards.append(at)
            if len(shards) >= o.combine_keys:
                yield flush()
                held, shards = Live(), []
        if shards:
            yield flush()

    return dealt.mapInArrow(
        run, f"shard int, digest binary, rows bigint, n_chars bigint, id {kind}, row bigint"
    )


def _saved(shard: int, live: Live, id_type: pa.DataType) -> pa.Table:
    at = list(live.filter.live())
    numbers = [n for _, n in at]
    return pa.table(
        {
            "shard": pa.array([shard] * len(at), pa.int32()),
            "buckets": pa.array([live.filter.buckets] * len(at), pa.int32()),
            "slot": pa.array([s for s, _ in at], pa.int32()),
            "digest": pa.array([live.filter.keys[n] for n in numbers], pa.binary()),
            "rows": pa.array([live.rows[n] for n in numbers], pa.int64()),
            **_columns([live.best[n] for n in numbers], id_type),
        }
    )


def _loaded(entries: pa.Table) -> Live:
    if not entries.num_rows:
        return Live()
    digests = entries.column("digest").to_pylist()
    slots = entries.column("slot").to_pylist()
    live = Live(CuckooFilter.restore(entries.column("buckets")[0].as_py(), slots, digests))
    for _, rows, best in _entries(entries):
        live.rows.append(rows)
        live.best.append(best)
    return live


def _index_schema(rows: DataFrame) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return (
        "shard int, buckets int, slot int, digest binary, rows bigint, "
        f"n_chars bigint, id {kind}, row bigint"
    )


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def build(rows: DataFrame, shards: int, options: Options = Options()) -> DataFrame:
    """The index of ``rows_of`` rows. A task holds one shard: choose about one
    for each ``Options.shard_keys`` digests."""

    def fill(changes: pa.Table) -> pa.Table:
        live = Live(CuckooFilter(min(changes.num_rows, options.shard_keys)))
        for entry in _entries(changes):
            live.insert(*entry)
        return _saved(changes.column("shard")[0].as_py(), live, changes.schema.field("id").type)

    dealt = _changes(rows, shard_of(shards), options)
    return dealt.groupBy("shard").applyInArrow(fill, _index_schema(rows))


def _update(index: DataFrame, rows: DataFrame, shards: int, o: Options, delete: bool) -> DataFrame:
    def apply(entries: pa.Table, changes: pa.Table) -> pa.Table:
        live = _loaded(entries)
        change = live.delete if delete else live.insert
        for entry in _entries(changes):
            change(*entry)
        known = entries if entries.num_rows else changes
        return _saved(known.column("shard")[0].as_py(), live, known.schema.field("id").type)

    dealt = _changes(rows, shard_of(shards), o)
    both = index.groupBy("shard").cogroup(dealt.groupBy("shard"))
    return both.applyInArrow(apply, _index_schema(rows))


def insert(index: DataFrame, rows: DataFrame, shards: int, options: Options = Options()) -> DataFrame:
    """The index with more rows; ``shards`` as it was built with."""
    return _update(index, rows, shards, options, delete=False)


def delete(
    index: DataFrame, rows: DataFrame, left: DataFrame, shards: int, options: Options = Options()
) -> DataFrame:
    """The index without ``rows``, which were inserted before; ``left`` has all
    rows that stay. Digests without rows leave the filter; where the row that
    stayed has gone, the next one is found among ``left``. Unknown digests are
    ignored."""
    stage = kit.Stage(index.sparkSession)
    after = stage.table(_update(index, rows, shards, options, delete=True), "index")
    stale = after.where(F.col("row").isNull()).select("digest")
    best = F.min_by(
        F.struct("n_chars", "id", "row"),
        F.struct(-F.col("n_chars"), F.col("id").isNull(), "id", "row"),
    )
    found = left.join(stale, "digest", "left_semi").groupBy("digest").agg(best.alias("next"))
    joined = after.join(found, "digest", "left")
    fields = [F.coalesce(n, F.col("next")[n]).alias(n) for n in ("n_chars", "row")]
    id_ = F.when(F.col("row").isNull(), F.col("next")["id"]).otherwise(F.col("id"))
    kept = ("shard", "buckets", "slot", "digest", "rows")
    return joined.select(*kept, fields[0], id_.alias("id"), fields[1])


def resolve(rows: DataFrame, index: DataFrame, options: Options = Options()) -> DataFrame:
    """``rows`` with ``keep_id``, ``group_size`` and ``kept``.

    Only digests of more than one row are looked up. The most repeated ones, at
    most ``broadcast_groups`` by the pigeonhole bound, are broadcast, which
    settles all hot texts in place; what is left is few rows for each digest.
    """
    stage = kit.Stage(rows.sparkSession)
    repeated = index.where(F.col("rows") > 1).select(
        "digest", F.col("rows").alias("size"), F.col("id").alias("best_id"), F.col("row").alias("best_row")
    )
    repeated = stage.table(repeated, "repeated")
    groups, copies = repeated.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot = copies // options.broadcast_groups + 1 if groups > options.broadcast_groups else 0
    first = F.broadcast(repeated.where(F.col("size") >= hot))
    found = rows.join(first, "digest", "left")
    if hot:
        rest = repeated.where(F.col("size") < hot).select(
            F.col("digest").alias("key"),
            *(F.col(n).alias(f"rest_{n}") for n in ("size", "best_id", "best_row")),
        )
        # Settled rows get a key of their own and spread over all tasks.
        own = F.encode(F.col("row").cast("string"), "UTF-8")
        found = found.withColumn("key", F.when(F.col("size").isNull(), F.col("digest")).otherwise(own))
        found = found.join(rest, "key", "left").withColumns(
            {n: F.when(F.col("size").isNotNull(), F.col(n)).otherwise(F.col(f"rest_{n}"))
             for n in ("best_id", "best_row")}
            | {"size": F.coalesce("size", "rest_size")}
        )
    single = F.col("size").isNull()
    return found.select(
        "id",
        "digest",
        "n_chars",
        F.when(single, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("best_row"))).alias("kept"),
    )


def mark(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()
) -> DataFrame:
    """(id, digest, n_chars, keep_id, group_size, kept) for every row of ``df``.

    Texts are equal when they are identical without ASCII blanks; null counts as
    empty, so null, empty and blank texts are one group. Of a group the row with
    the most code points stays, then the smallest id (null last); of rows that
    repeat both, exactly one stays. Whole texts are hashed, however long; they do
    not move. No rows, no rows. Other columns are left out.
    """
    stage = kit.Stage(df.sparkSession)
    rows = stage.table(rows_of(df, id_col, text_col), "rows")
    shards = max(1, -(-rows.count() // options.shard_keys))
    index = stage.table(build(rows, shards, options), "index")
    return resolve(rows, index, options)
