"""MinHash near-dedup with SetSketch registers.

A register holds the floor of the logarithm of a minimum: exponentially spaced,
truncated minima, so sketches merge by maximum and equal registers tell of
similar sets. Equal texts are one set from the start. Then

1. bands of registers put sets into buckets; in each bucket every set is paired
   with the bucket's smallest, never with all;
2. a pair's similarity is estimated by maximum likelihood over the registers that
   are larger, smaller and equal, with the known set sizes; pairs near enough join
   sets into clusters;
3. sets that share a bucket but not a cluster are compared too, block by block
   where the bucket's sketches lie, so nothing depends on who was smallest;
4. inside a cluster all pairs are confirmed on full sets, block by block: a set is
   written as its difference from the cluster's first set, which is small, and a
   block pair yields only the links that connect something new.

Components of the confirmed links are the answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm import kit
from revlens.llm.graph import components
from revlens.llm.words import mix, row_keys, words_of


@dataclass(frozen=True)
class Options:
    """Links are pairs of sets with 100 * intersection >= percent * union. A pair
    of 0.8 shares none of 50 bands of 6 registers once in four million; an
    estimate from 300 registers is off by 0.2 once in 10^17."""

    shingle: int = 2
    percent: int = 80
    bands: int = 50
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    near: float = 0.6
    block: int = 96
    bucket_block: int = 256

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def sets_of(texts: list[str], o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and where each text's
    begin (and the end). Fewer words than a shingle are one shingle."""
    w = words_of(texts, lower=True)
    count = len(w.hash)
    shingles = np.zeros(count, np.uint64)
    width = np.minimum(o.shingle, np.diff(w.first))
    here = width[w.owner]
    inside = np.arange(count) - w.first[w.owner]
    last = np.diff(w.first)[w.owner] - here
    begins = np.flatnonzero(inside <= last)
    for k in range(o.shingle):
        use = begins[here[begins] > k]
        shingles[use] = shingles[use] * np.uint64(0x9E3779B97F4A7C15) + w.hash[use + k]
    values, owner = mix(shingles[begins] + here[begins].astype(np.uint64)), w.owner[begins]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def seeds(o: Options) -> np.ndarray:
    return mix(np.arange(1, o.registers + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


STEP = 1 << 16


def sketches(values: np.ndarray, begin: np.ndarray, o: Options) -> np.ndarray:
    """(sets, registers) of non-empty sets."""
    least = np.empty((len(begin) - 1, o.registers), np.uint64)
    row = 0
    while row < len(begin) - 1:
        stop = max(row + 1, int(np.searchsorted(begin, begin[row] + STEP, "right")) - 1)
        part, at = values[begin[row] : begin[stop]], begin[row:stop] - begin[row]
        for k, seed in enumerate(seeds(o)):
            least[row:stop, k] = np.minimum.reduceat(part * seed, at)
        row = stop
    smallest = -np.log1p(-np.minimum((least + np.float64(1.0)) / 2.0**64, 1 - 2.0**-53)) / o.rate
    found = np.floor(1 - np.log(smallest) / np.log(o.base))
    return np.clip(found, 0, 65535).astype(np.uint16)


def estimates(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, o: Options
) -> np.ndarray:
    """The likeliest similarity of each pair of sketches, to a hundredth."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = o.registers - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (o.base - 1) / o.base) / np.log(o.base)

    tiny = 1e-12
    x, y = p(np.maximum(u - v * grid, 0)), p(np.maximum(v - u * grid, 0))
    chance = np.log(np.maximum([x, y, 1 - x - y], tiny))
    likely = more * chance[0] + less * chance[1] + same * chance[2]
    likely[(grid > np.minimum(u / v, v / u) + 0.005)] = -np.inf
    return grid[0, likely.argmax(1)]


ROW = "key {key}, k1 bigint, k2 bigint, d1 bigint, d2 bigint, n bigint, sketch binary"


def _sketched(keyed: DataFrame, o: Options) -> DataFrame:
    """A row for each text; a sketch comes with the first of equal sets in a
    step, and none with an empty set."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, begin = sets_of(kit.texts_of(batch), o)
            sizes = np.diff(begin)
            digests = [
                hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest()
                for a, b in zip(begin, begin[1:])
            ]
            seen: dict[bytes, int] = {}
            for row in np.flatnonzero(sizes):
                seen.setdefault(digests[row], row)
            rows = np.fromiter(seen.values(), np.int64, len(seen))
            packed: list[bytes | None] = [None] * len(sizes)
            if len(rows):
                own = np.concatenate([values[begin[r] : begin[r + 1]] for r in rows])
                found = sketches(own, np.r_[0, np.cumsum(sizes[rows])], o)
                for row, sketch in zip(rows, found):
                    packed[row] = sketch.astype("<u2").tobytes()
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return kit.columns(
                key=batch.column("key"),
                k1=batch.column("k1"),
                k2=batch.column("k2"),
                d1=halves[:, 0].copy(),
                d2=halves[:, 1].copy(),
                n=sizes,
                sketch=pa.array(packed, pa.binary()),
            )

        return work

    key = keyed.schema["key"].dataType.simpleString()
    return kit.map_texts(keyed, make, ROW.format(key=key))


def _banded(sets: DataFrame, o: Options) -> DataFrame:
    """(band, value, sid) for each set and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column("sketch").to_pylist())
            regs = np.frombuffer(raw, "<u2").reshape(-1, o.bands, o.rows).astype(np.uint64)
            value = np.zeros(regs.shape[:2], np.uint64)
            for k in range(o.rows):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, k] + np.uint64(1))
            count = len(value)
            yield kit.columns(
                band=np.tile(np.arange(o.bands, dtype=np.int32), count),
                value=value.ravel().view(np.int64),
                sid=np.repeat(batch.column("sid").to_numpy(), o.bands),
            )

    return sets.select("sid", "sketch").mapInArrow(run, "band int, value bigint, sid bigint")


def _near(pairs: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """The pairs (a, b) whose estimate is near enough for a link."""

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}")
        )

    # Set sizes alone rule out a pair whose smaller set is too small.
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * o.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, o.registers)
                for c in ("s_a", "s_b")
            )
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            for at in range(0, len(a), 2000):
                to = at + 2000
                near = estimates(a[at:to], b[at:to], sizes[0][at:to], sizes[1][at:to], o) >= o.near
                part = batch.slice(at, 2000).select(["a", "b"])
                yield part.filter(pa.array(near))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def dealt_in_blocks(df: DataFrame, *group: str) -> DataFrame:
    """Rows (group, sid, blocks, ..) dealt to the pairs (i, j) of their group's
    blocks, a group's pair together and in order; ``right`` marks block j."""
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    split = df.withColumn("own", own).withColumn("other", other)
    dealt = split.select(
        *[c for c in df.columns if c != "blocks"],
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("right"),
    )
    return dealt.repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j")


def groups_of(
    batches: Iterator[pa.RecordBatch], *keys: str
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of equal keys from sorted batches, with where each begins."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        values = [held.column(c).to_numpy() for c in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        if len(cuts):
            yield held.slice(0, cuts[-1]), np.r_[0, cuts]
            held = held.slice(cuts[-1]).combine_chunks()
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _cross(mixed: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """Near pairs (a, b) between different clusters of a bucket, found where the
    bucket's sketches lie, so that pairs which are not near are never rows. Of the
    near ones, only those that connect something new are."""
    wide = mixed.join(sets.select("sid", "n", "sketch"), "sid")
    dealt = dealt_in_blocks(wide, "band", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in groups_of(batches, "band", "value", "i", "j"):
            sid, root, n, right, i, j = (
                table.column(c).to_numpy() for c in ("sid", "root", "n", "right", "i", "j")
            )
            raw = table.column("sketch").to_pylist()
            a, b = [], []
            for low, high in zip(cuts, cuts[1:]):
                regs = np.frombuffer(b"".join(raw[low:high]), "<u2").reshape(-1, o.registers)
                size, own = n[low:high].astype(float), root[low:high]
                may = np.triu(own[:, None] != own[None, :], 1)
                may &= np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * o.percent
                if i[low] != j[low]:
                    may &= right[low:high, None] != right[None, low:high]
                x, y = np.nonzero(may)
                near = np.zeros(len(x), bool)
                for at in range(0, len(x), 2000):
                    p, q = x[at : at + 2000], y[at : at + 2000]
                    near[at : at + 2000] = estimates(regs[p], regs[q], size[p], size[q], o) >= o.near
                for p, q in forest(x[near], y[near], high - low, own):
                    a.append(sid[low + p])
                    b.append(sid[low + q])
            if a:
                yield kit.columns(a=np.array(a, np.int64), b=np.array(b, np.int64))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def forest(
    x: np.ndarray, y: np.ndarray, count: int, root: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """The pairs that connect something new; rows of one root are connected."""
    parent = list(range(count))
    if root is not None:
        first: dict[int, int] = {}
        parent = [first.setdefault(r, k) for k, r in enumerate(root.tolist())]

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for p, q in zip(x.tolist(), y.tolist()):
        s, t = top(p), top(q)
        if s != t:
            parent[t] = s
            out.append((p, q))
    return out


def _clusters(sets: DataFrame, stage: kit.Stage, o: Options) -> DataFrame:
    """(node, root) of the sets that may have links; links stay inside roots."""
    banded = _banded(sets, o)
    full = banded.groupBy("band", "value").agg(F.count("*").alias("m"), F.min("sid").alias("least"))
    members = stage.table(
        banded.join(full.where("m > 1").drop("m"), ["band", "value"]), "members"
    )
    stars = members.where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    # One edge for each set is enough: what it would have joined besides shares a
    # bucket with it, and is found below.
    near = _near(stars.distinct(), sets, o).groupBy("b").agg(F.min("a").alias("a"))
    edges = stage.table(near.select("a", "b"), "edges")
    roots = components(edges, stage)

    # Buckets whose sets are not all of one cluster.
    placed = stage.table(
        members.join(roots, F.col("sid") == F.col("node"), "left").select(
            "band", "value", "sid", F.coalesce("root", "sid").alias("root")
        ),
        "placed",
    )
    mixed = (
        placed.groupBy("band", "value")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"))
        .where("low <> high")
        .select("band", "value", F.ceil(F.col("m") / F.lit(o.bucket_block)).cast("long").alias("blocks"))
    )
    more = stage.table(_cross(placed.join(mixed, ["band", "value"]), sets, o), "more_edges")
    stage.drop(members, placed)
    if more.isEmpty():
        return roots
    out = components(edges.unionByName(more), stage)
    stage.drop(edges, more, roots)
    return out


def _full_sets(keyed: DataFrame, wanted: DataFrame, o: Options) -> DataFrame:
    """(sid, root, n, items) of the wanted (k1, k2, sid, root, n)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, begin = sets_of(kit.texts_of(batch), o)
            items = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), values.view(np.int64))
            own = [batch.column(c) for c in ("sid", "root", "n")]
            return pa.RecordBatch.from_arrays([*own, items], names=["sid", "root", "n", "items"])

        return work

    texts = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"])
    schema = "sid bigint, root bigint, n bigint, items array<bigint>"
    found = kit.map_texts(texts, make, schema)
    # A row that is there twice brings its set twice.
    return found.dropDuplicates(["sid"])


def _links(full: DataFrame, stage: kit.Stage, o: Options) -> DataFrame:
    """Links (a, b), enough to connect all that links connect."""
    first = full.where("sid = root").select("root", F.col("items").alias("model"))
    sizes = full.groupBy("root").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / F.lit(o.block)).cast("long")
    differ = F.array_union(F.array_except("items", "model"), F.array_except("model", "items"))
    split = (
        full.join(first, "root")
        .join(sizes, "root")
        .where("members > 1")
        .select("sid", "root", "n", differ.alias("items"), blocks.alias("blocks"))
    )
    dealt = dealt_in_blocks(split, "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in groups_of(batches, "root", "i", "j"):
            yield from _confirmed(table, cuts, o)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _confirmed(table: pa.Table, cuts: np.ndarray, o: Options) -> Iterator[pa.RecordBatch]:
    sid, size = table.column("sid").to_numpy(), table.column("n").to_numpy()
    right = table.column("right").to_numpy()
    one_block = table.column("i").to_numpy() == table.column("j").to_numpy()
    items = table.column("items").combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    begin = items.offsets.to_numpy()
    values = items.values.to_numpy()
    a, b = [], []
    for low, high in zip(cuts, cuts[1:]):
        for x, y in linked(
            values[begin[low] : begin[high]], begin[low : high + 1] - begin[low],
            size[low:high], None if one_block[low] else right[low:high], o,
        ):
            a.append(sid[low + x])
            b.append(sid[low + y])
    if a:
        yield kit.columns(a=np.array(a, np.int64), b=np.array(b, np.int64))


def linked(
    values: np.ndarray, begin: np.ndarray, size: np.ndarray, right: np.ndarray | None, o: Options
) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets given as differences from one
    model, or between the two sides if ``right`` tells them apart."""
    count = len(size)
    lengths = np.diff(begin)
    _, item = np.unique(values, return_inverse=True)
    dense = np.zeros((count, int(item.max(initial=-1)) + 1), np.float32)
    dense[np.repeat(np.arange(count), lengths), item] = 1
    common = (dense @ dense.T).astype(np.int64)
    apart = lengths[:, None] + lengths[None, :] - 2 * common
    both = size[:, None] + size[None, :]
    # 2 * intersection = both - apart, 2 * union = both + apart.
    link = 100 * (both - apart) >= o.percent * (both + apart)
    if right is not None:
        link &= right[:, None] != right[None, :]
    x, y = np.nonzero(np.triu(link, 1))
    return forest(x, y, count)


def _labelled(
    df: DataFrame, stage: kit.Stage, o: Options, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """The rows (k1, k2, d1, d2, key, n), and the sets (d1, d2, least, pick, root):
    a set's smallest id, and its row of smallest (id, k1, k2), null ids last."""
    k1, k2 = row_keys(df, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("key"), text.alias("text"))
    rows = stage.table(_sketched(keyed, o), "rows")
    groups = rows.where("n > 0").groupBy("d1", "d2").agg(
        F.min("key").alias("least"),
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "k1", "k2")).alias("pick"),
        F.max("n").alias("n"),
        F.first("sketch", ignorenulls=True).alias("sketch"),
        F.min(F.struct("k1", "k2")).alias("from"),
    )
    # Written once, so the numbers stay.
    sets = stage.table(groups.withColumn("sid", F.monotonically_increasing_id()), "sets")
    clusters = _clusters(sets, stage, o)
    wanted = sets.join(clusters, F.col("sid") == F.col("node")).select(
        "from.k1", "from.k2", "sid", "root", "n"
    )
    full = stage.table(_full_sets(keyed, wanted, o), "full_sets")
    links = stage.table(_links(full, stage, o), "links")
    stage.drop(full)
    roots = components(links, stage)
    return rows, sets.join(roots, F.col("sid") == F.col("node"), "left").select(
        "d1", "d2", "least", "pick", F.coalesce("root", "sid").alias("root")
    )


def near_duplicates(
    df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(k1, k2, id, n_shingles, component_id) for each row: the row's key, its number
    of distinct shingles, and the smallest id that links reach.

    A null or blank text has no shingles and is its own component. Rows that
    repeat an id and a text share their component; a null id is never smallest,
    and a component of null ids alone has a null. Empty tables give no rows.
    """
    o = options
    stage = kit.Stage(df.sparkSession)
    rows, labelled = _labelled(df, stage, o, id_col, text_col)
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    by_set = stage.table(labelled.join(smallest, "root").select("d1", "d2", "component"), "by_set")
    return rows.join(by_set, ["d1", "d2"], "left").select(
        "k1",
        "k2",
        F.col("key").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"),
    )


def one_of_each(
    df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows whose id is their component's, with all columns. Rows with a null
    id stay only if their component has no other id."""
    found = near_duplicates(df, options, id_col, text_col)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select("k1", "k2").distinct()
    k1, k2 = row_keys(df, id_col, text_col)
    names = ["k1", "k2"]
    own = df.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    return own.join(kept, names, "left_semi").select("row.*")


def first_of_each(
    df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Exactly one row of each component, with all columns: that of the smallest
    id, null ids last, then of the smallest key. Of rows that repeat its id and
    text one stays, as for a blank text, which has no other row in its component."""
    rows, labelled = _labelled(df, kit.Stage(df.sparkSession), options, id_col, text_col)
    picked = labelled.groupBy("root").agg(F.min("pick").alias("pick")).select("pick.k1", "pick.k2")
    blank = rows.where("n = 0").select("k1", "k2").distinct()
    k1, k2 = row_keys(df, id_col, text_col)
    own = df.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    kept = own.join(picked.unionByName(blank), ["k1", "k2"], "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select("row.*")
