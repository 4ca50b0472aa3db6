"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens: its documents, in block order, each closed by
an end token. A window of ``length`` tokens grants every queue its quantum (its
share of a window), adds it to the queue's deficit, and takes the whole tokens
that the deficit covers; what is left of the window goes one token at a time to
the largest deficits. Deficits are carried from window to window.

Windows are planned in runs of ``run_windows``. Where a run begins in each queue
follows from its number alone (an exact, monotone apportionment of the tokens
before it, within a few tokens of the target), so any task plans any run, with
the deficits carried into it, and tasks agree without talking to each other.

More sources than ``fan_out`` are dealt into groups, and groups into groups, until
one plan has few enough queues. A group is a queue whose tokens are in the order of
its own plan, by the same round-robin, with windows as long as the group's share of
one. So every source has a queue and a deficit, and no plan grows with their number.
Target shares are the sources' own shares of all tokens unless ``targets`` names
others. With their own shares all queues end together; with others, a queue that has
ended leaves its share to the rest in proportion. Every token is used either way, and
only the last window is short.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from fractions import Fraction
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from revlens.llm import kit
from revlens.llm.bpe import byte_letters, parts_of


@dataclass(frozen=True)
class Options:
    """A plan has at most about ``fan_out`` queues; ``group_windows`` are the
    windows in a run of a group's plan, ``salts`` the parts that groups are joined in."""

    length: int = 2048
    end_id: int = 1
    fan_out: int = 256
    run_windows: int = 256
    group_windows: int = 16
    salts: int = 32


class Mixture:
    """The plan of all windows for queues of the given token totals."""

    def __init__(
        self, totals: list[int], options: Options, held: int = 64, weights: list[int] | None = None
    ):
        """``weights``: what a window's tokens are dealt by instead of the totals."""
        self.totals, self.options, self.held, self.weights = totals, options, held, weights
        self.all = sum(totals)
        if weights:
            # Queues in the order in which they end.
            self.ending = sorted(
                (k for k in range(len(totals)) if totals[k]), key=lambda k: Fraction(totals[k], weights[k])
            )
        self.run_tokens = options.length * options.run_windows
        self.runs = -(-self.all // self.run_tokens)
        self._plans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._starts: dict[int, list[int]] = {}

    def starts(self, run: int) -> list[int]:
        """Tokens of each queue before a run. A half of the queues gets the
        floor of its share, the other the rest, and so on down to one queue: sums
        are exact and no count ever falls from one run to the next."""
        if run not in self._starts:
            if len(self._starts) > 4 * self.held:
                self._starts.clear()
            out = [0] * len(self.totals)
            todo = [(0, len(self.totals), min(run * self.run_tokens, self.all))]
            while todo:
                low, high, tokens = todo.pop()
                if high - low == 1:
                    out[low] = tokens
                elif high > low:
                    middle = (low + high) // 2
                    left = self._left(low, middle, high, tokens)
                    todo += [(low, middle, left), (middle, high, tokens - left)]
            self._starts[run] = out
        return self._starts[run]

    def _left(self, low: int, middle: int, high: int, tokens: int) -> int:
        """What the first of two halves has given when both have given so many."""
        if not self.weights:
            whole = sum(self.totals[low:high])
            return tokens * sum(self.totals[low:middle]) // whole if whole else 0
        ended, over, parts = self._level(low, high, tokens)
        left = sum(self.totals[k] for k in ended if k < middle)
        going = sum(self.weights[k] for k in parts if k < middle)
        return left + (over * going // sum(self.weights[k] for k in parts) if parts else 0)

    def _level(self, low: int, high: int, tokens: int) -> tuple[list[int], int, list[int]]:
        """The queues that have ended when a range has given so many tokens, the
        tokens of the others, and the others."""
        order = [k for k in self.ending if low <= k < high]
        weight = sum(self.weights[k] for k in order)
        for at, k in enumerate(order):
            if self.totals[k] * weight > tokens * self.weights[k]:
                return order[:at], tokens, order[at:]
            tokens -= self.totals[k]
            weight -= self.weights[k]
        return order, 0, []

    def _owed(self, tokens: int, given: list[int]) -> np.ndarray:
        """The deficits of all queues after so many tokens in all."""
        if not self.weights:
            return np.array([(tokens * t - x * self.all) / self.all for t, x in zip(self.totals, given)])
        ended, over, parts = self._level(0, len(self.totals), tokens)
        due = [Fraction(0)] * len(self.totals)
        whole = sum(self.weights[k] for k in parts)
        for k in ended:
            due[k] = Fraction(self.totals[k])
        for k in parts:
            due[k] = Fraction(over * self.weights[k], whole)
        return np.array([float(d - x) for d, x in zip(due, given)])

    def plan(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """For a run's windows, where each begins in each queue (one row more
        than windows), and where each queue's tokens begin in the window."""
        if run not in self._plans:
            if len(self._plans) >= self.held:
                self._plans.clear()
            self._plans[run] = self._round_robin(run)
        return self._plans[run]

    def _round_robin(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        length = self.options.length
        first, last = self.starts(run), self.starts(run + 1)
        before = min(run * self.run_tokens, self.all)
        deficit = self._owed(before, first)
        weights = np.array(self.weights or self.totals, float)
        share = weights / weights.sum()
        left = np.array([b - a for a, b in zip(first, last)], np.int64)
        takes = []
        while rest := int(left.sum()):
            room = min(length, rest)
            if self.weights:
                # What has ended in this run leaves its share to the rest.
                share = weights * (left > 0) / weights[left > 0].sum()
            deficit += room * share
            take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
            spare = room - int(take.sum())
            while spare:
                owed = deficit - take
                can = (take < left) if spare > 0 else (take > 0)
                order = np.argsort(-owed if spare > 0 else owed, kind="stable")
                served = order[can[order]][: abs(spare)]
                take[served] += 1 if spare > 0 else -1
                spare = room - int(take.sum())
            deficit -= take
            left -= take
            takes.append(take)
        takes = np.array(takes).reshape(-1, len(self.totals))
        edges = np.vstack([np.zeros((1, len(first)), np.int64), takes.cumsum(0)])
        return edges + np.array(first, np.int64), takes.cumsum(1) - takes

    def run_of(self, queue: int, place: int) -> int:
        """The run that holds a token of a queue."""
        if self.weights:
            return bisect_right(range(self.runs), place, key=lambda r: self.starts(r)[queue]) - 1
        run = min(place * self.all // max(self.totals[queue], 1) // self.run_tokens, self.runs - 1)
        while self.starts(run)[queue] > place:
            run -= 1
        while self.starts(run + 1)[queue] <= place:
            run += 1
        return run

    def cut(self, queue: int, begin: int, end: int) -> np.ndarray:
        """Place, tokens, window and offset of each piece of a stretch of a queue, as rows."""
        found = [np.zeros((4, 0), np.int64)]
        run = self.run_of(queue, begin) if begin < end else 0
        while begin < end:
            edges, offsets = self.plan(run)
            edge = edges[:, queue]
            low, high = int(edge.searchsorted(begin, "right")) - 1, int(edge.searchsorted(end))
            high = min(high, len(edge) - 1)
            if low < high:
                place = np.maximum(edge[low:high], begin)
                size = np.minimum(edge[low + 1 : high + 1], end) - place
                window = np.arange(low, high) + run * self.options.run_windows
                pieces = np.array([place, size, window, offsets[low:high, queue] + place - edge[low:high]])
                found.append(pieces[:, size > 0])
                begin = int(place[-1] + size[-1])
            run += 1
        return np.concatenate(found, 1)

    def pieces(self, queue: int, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(place, tokens, window, offset) of each piece of a stretch of a queue."""
        return map(tuple, self.cut(queue, begin, end).T.tolist())


class Tree:
    """The root's plan, and the plans of groups as rows bring their totals.
    ``grouped``: the tokens of all sources in groups, and their share of a window."""

    def __init__(
        self, totals: list[int], options: Options, weights: list[int] | None = None,
        grouped: tuple[int, Fraction] | None = None,
    ):
        self.options = options
        self.root = Mixture(totals, options, weights=weights)
        self.grouped = grouped or (self.root.all, Fraction(1))
        self._groups: dict[tuple[int, int], Mixture] = {}

    def group(self, level: int, node: int, totals: list[int]) -> Mixture:
        if (level, node) not in self._groups:
            if len(self._groups) >= 256:
                self._groups.clear()
            tokens, share = self.grouped
            length = max(1, int(self.options.length * share * sum(totals) / tokens))
            own = replace(self.options, length=length, run_windows=self.options.group_windows)
            self._groups[level, node] = Mixture(totals, own, 4)
        return self._groups[level, node]

    def cut(
        self, path: list[list[int]], node: int, queue: int, place: int, tokens: int
    ) -> np.ndarray:
        """Start, tokens, window and offset of each piece of a stretch of a source, as rows:
        a piece of a group's plan is a stretch of the queue that the group is in the
        next plan. ``path`` has the totals of the groups from the source upwards,
        ``node`` is the number of the first."""
        plans = []
        for level, totals in enumerate(path):
            plans.append((self.group(level, node, totals), queue))
            node, queue = divmod(node, self.options.fan_out)
        return self._laid(plans + [(self.root, queue)], place, tokens)

    def _laid(self, plans: list, place: int, tokens: int) -> np.ndarray:
        (mixture, queue), *above = plans
        if not above:
            pieces = mixture.cut(queue, place, place + tokens)
            pieces[0] -= place
            return pieces
        found = [np.zeros((4, 0), np.int64)]
        for begin, size, window, offset in mixture.pieces(queue, place, place + tokens):
            found.append(self._laid(above, window * mixture.options.length + offset, size))
            found[-1][0] += begin - place
        return np.concatenate(found, 1)


# Letters below this code are letters in every version of Unicode.
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
# What the own splitting is not for: other than ASCII and these letters.
_OTHER = r"[^\x01-\x7F\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
# The library's splitting, for parts that are joined by the mark of a cut.
_PIECE = re.compile(
    rf"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s\0{_LATIN}0-9]+|\s+(?![^\s\0])|\s+",
    re.ASCII,
)
# Texts in which not every space opens a part, or that hold the mark of a cut.
_ODD = (
    r"\x00| [\x09-\x0D\x1C-\x20]| \z"
    r"|[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _laid(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(total)]


class Pieces:
    """Ids of pieces that the library merges, remembered until so many characters
    are held. Piece 0 is the mark between parts and has none."""

    def __init__(self, make: Callable[[list[str]], tuple[list[int], list[int]]], held: int = 3_000_000):
        self.make, self.most = make, held
        self._forget()

    def _forget(self) -> None:
        # A new piece gets the next number.
        self.number, self.held = defaultdict(count().__next__), 0
        self.number["\0"]
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Their places in ``sizes``, until the next call."""
        if self.held > self.most or len(self.number) != len(self.sizes):
            self._forget()
        out = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        new = len(self.number) - len(self.sizes)
        if new:
            missing = list(islice(reversed(self.number), new))[::-1]
            ids, sizes = self.make(missing)
            self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
            self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
            self.held += sum(map(len, missing))
        return out

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.sizes)
        return _laid(self.flat, (ends - self.sizes)[numbers], self.sizes[numbers])


class Library:
    """The tokenizers library's ids, with the pieces of texts remembered. A step's
    texts are cut and their distinct parts found by Arrow, so Python sees each
    distinct part once, and ids are laid out by gathers. Parts of ASCII and Latin
    letters are split here, all in one go, and their pieces go straight to the
    library's merges, in its byte letters; all other parts, and whole texts of other
    than byte-level tokenizers, go through all of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        form = json.loads(self.library.to_str())
        splits = form["pre_tokenizer"] or {}
        self.in_parts = (
            splits.get("type") == "ByteLevel"
            and splits.get("use_regex")
            and not splits.get("add_prefix_space")
            and form["normalizer"] is None
        )
        self.pieces = Pieces(self._merged)
        if self.in_parts:
            letter = {b: c for c, b in byte_letters().items()}
            self.letters = {k: "".join(letter[b] for b in chr(k).encode()) for k in range(0x250)}
            self.space = letter[ord(" ")]
            added = [re.escape(t["content"]) for t in form.get("added_tokens") or []]
            self.added = re.compile("|".join(added)) if added else None

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """The ids of pieces, none of which is split further, and how many each has."""
        spaced = "\uffff".join(pieces).replace(" ", self.space).split("\uffff")
        # Other visible ASCII stands for itself.
        lettered = [
            q if p.isascii() and p.isprintable() else p.translate(self.letters)
            for p, q in zip(pieces, spaced)
        ]
        merge = self.library.model.tokenize
        ids: list[int] = []
        sizes = []
        # One by one: lists that are kept make the garbage collector look through all.
        for p in lettered:
            tokens = merge(p)
            sizes.append(len(tokens))
            ids += [t.id for t in tokens]
        return ids, sizes

    def _ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has."""
        other = pa.compute.match_substring_regex(parts, _OTHER).to_numpy(zero_copy_only=False)
        words = parts.to_numpy(zero_copy_only=False).tolist()
        if self.added and self.added.search("\0".join(words)):
            other = other | np.array([bool(self.added.search(w)) for w in words])
        own = np.flatnonzero(~other)
        sizes = np.zeros(len(words), np.int64)
        flat = []
        if len(own):
            pieces = _PIECE.findall("\0".join(words if len(own) == len(words) else [words[k] for k in own.tolist()]))
            numbers = self.pieces.numbers(pieces)
            counts = self.pieces.sizes[numbers]
            sizes[own] = np.bincount(np.cumsum(numbers == 0), weights=counts, minlength=len(own)).astype(np.int64)
            flat.append(self.pieces.ids(numbers))
        rest = np.flatnonzero(other)
        if len(rest):
            found = self._encode([words[k] for k in rest.tolist()])
            sizes[rest] = list(map(len, found))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
        if not len(own) or not len(rest):
            return flat[0] if flat else np.zeros(0, np.uint32), sizes
        order = np.r_[own, rest]
        begins = np.zeros(len(words), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return _laid(np.concatenate(flat), begins, sizes), sizes

    def _cut(self, parts: pa.Array, counts: np.ndarray) -> list[bytes]:
        """The ids of texts given as all their parts and the parts of each."""
        coded = parts.dictionary_encode()
        flat, sizes = self._ids(coded.dictionary)
        codes = coded.indices.to_numpy()
        begins = np.cumsum(sizes) - sizes
        sizes = sizes[codes]
        raw = _laid(flat, begins[codes], sizes).astype("<u4").tobytes()
        bounds = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]] * 4
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not self.in_parts:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            return [np.array(i, "<u4").tobytes() for i in self._encode(texts)]
        whole = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        odd = pa.compute.match_substring_regex(whole, _ODD).to_numpy(zero_copy_only=False)
        plain = whole.filter(pa.array(~odd))
        marked = pa.compute.replace_substring(plain, " ", "\0 ")
        lists = pa.compute.split_pattern(marked, "\0")
        counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for row, ids in zip(np.flatnonzero(~odd).tolist(), self._cut(lists.flatten(), counts)):
            out[row] = ids
        rows = np.flatnonzero(odd).tolist()
        cut = [parts_of(text) for text in whole.filter(pa.array(odd)).to_pylist()]
        flat = pa.array(chain.from_iterable(cut), pa.large_string())
        for row, ids in zip(rows, self._cut(flat, np.array(list(map(len, cut)), np.int64))):
            out[row] = ids
        return out


@lru_cache(2)
def library(path: str) -> Library:
    """One for each Python worker. Spark's tasks are the parallel units; threads
    inside one only take turns."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Library(path)


def tokenized(df: DataFrame, path: str, options: Options) -> DataFrame:
    """(key, source, block, first, tokens, ids): each task is a block and counts,
    for each source, the tokens before a document. Ids are kept in 16 bits where
    the vocabulary allows."""

    def make():
        own = library(path)
        narrow = "<u2" if max(own.library.get_vocab_size(), options.end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([options.end_id], "<u4").tobytes()
        block = TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [i + end for i in own.encode(pa.compute.fill_null(batch.column("text"), ""))]
            first = []
            for source, i in zip(batch.column("source").to_pylist(), ids):
                first.append(seen.get(source, 0))
                seen[source] = first[-1] + len(i) // 4
            return kit.columns(
                key=batch.column("key"),
                source=batch.column("source"),
                block=pa.array([block] * len(ids), pa.int32()),
                first=pa.array(first, pa.int64()),
                tokens=pa.array([len(i) // 4 for i in ids], pa.int64()),
                ids=[np.frombuffer(i, "<u4").astype(narrow).tobytes() for i in ids],
            )

        return work

    key = df.schema["key"].dataType.simpleString()
    schema = f"key {key}, source string, block int, first bigint, tokens bigint, ids binary"
    return kit.map_texts(df, make, schema)


def pack(
    df: DataFrame,
    path: str,
    options: Options = Options(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = True,
    targets: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source), and its ids as an array if asked for.

    ``targets``: shares of a window for at most ``fan_out`` named sources, above 0
    and together below 1, or 1 where they are all; other sources share the rest by
    their tokens, and also what is named for sources without rows. Where every source
    is named, shares are taken in proportion.

    A null or empty text is a document of the end token alone; null sources are a
    source; rows with null or repeated ids are documents of their own; other
    columns are left out. A document of any length is cut across windows. An
    empty table gives no pieces.
    """
    stage = kit.Stage(df.sparkSession)
    narrow = df.select(
        F.col(id_col).alias("key"),
        F.col(text_col).cast("string").alias("text"),
        F.col(source_col).cast("string").alias("source"),
    )
    with kit.small_batches(df.sparkSession):
        docs = stage.table(tokenized(narrow, path, options), "ids")
    by_source = stage.table(docs.groupBy("source").agg(F.sum("tokens").alias("n")), "sources")
    if by_source.isEmpty():
        return df.sparkSession.createDataFrame([], _schema(df, id_col, with_ids))
    leaves, paths, tree = mixed(by_source, options, stage, targets or {})
    # Where a source's part of a block begins in its queue.
    parts = docs.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    bases = stage.table(
        parts.join(
            leaves.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))
        ).select(
            F.col("source").alias("of_source"), F.col("block").alias("of_block"), "node", "queue", "base"
        ),
        "bases",
    )
    placed = docs.join(
        bases,
        (F.col("block") == F.col("of_block")) & F.col("source").eqNullSafe(F.col("of_source")),
    ).withColumn("place", F.col("base") + F.col("first"))
    if paths is None:
        placed = placed.withColumn("path", F.lit(None).cast("array<array<bigint>>"))
    else:
        # A group's rows are split by their block, so that none is met by one task.
        salts = F.explode(F.sequence(F.lit(0), F.lit(options.salts - 1)))
        paths = paths.select(F.col("node").alias("of_node"), "path", salts.alias("salt"))
        placed = placed.join(
            paths,
            (F.col("node") == F.col("of_node")) & (F.col("block") % options.salts == F.col("salt")),
        )
    placed = placed.select("key", "source", "path", "node", "queue", "place", "tokens", "ids")
    shared = df.sparkSession.sparkContext.broadcast(tree)
    names = [id_col, *PIECE, *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = _pieces(batch.slice(at, 1000), shared.value, with_ids)
                yield out.rename_columns(names)

    return placed.mapInArrow(cut, _schema(df, id_col, with_ids))


SCALE = 10**9


def mixed(
    by_source: DataFrame, options: Options, stage: kit.Stage, targets: Mapping[str, float]
) -> tuple[DataFrame, DataFrame | None, Tree]:
    """The queue of each source, the groups' totals, and the plan. Named sources are
    queues of the root, and all others together are its queue 0."""
    if len(targets) > options.fan_out or any(v <= 0 for v in targets.values()):
        raise ValueError(f"targets: at most {options.fan_out} shares above 0")
    given = F.col("source").isin(list(targets)) & F.col("source").isNotNull()
    # At most fan_out rows.
    own = by_source.where(given).orderBy("source").collect() if targets else []
    rest = by_source.where(~given) if own else by_source
    sources = rest.count()
    taken = sum(targets[r["source"]] for r in own)
    if taken > 1 + 1e-9 or (own and sources and taken > 1 - 1 / SCALE):
        raise ValueError("targets: shares above 1, or nothing left for other sources")
    if not own:
        leaves, paths, totals = grouped(rest, sources, options, stage)
        return leaves, paths, Tree(totals, options)
    weights = [max(1, round(SCALE * targets[r["source"]])) for r in own]
    other = max(0, SCALE - sum(weights))
    named = by_source.sparkSession.createDataFrame(
        [(r["source"], 0, k) for k, r in enumerate(own, 1)], "source string, node int, queue int"
    )
    none = F.array().cast("array<array<bigint>>")
    if not sources:
        tree = Tree([0, *(r["n"] for r in own)], options, [1, *weights])
        return named, None, tree
    leaves, paths, totals = grouped(rest, sources, options, stage)
    # The rest's plan is one level more; a named source's path, of group -1, has none.
    last = F.array(F.array(*[F.lit(t).cast("bigint") for t in totals]))
    if paths is None:
        paths = leaves.select("node").distinct().withColumn("path", last)
    else:
        paths = paths.withColumn("path", F.concat("path", last))
    own_path = by_source.sparkSession.range(1).select(F.lit(-1).alias("node"), none.alias("path"))
    tree = Tree(
        [sum(totals), *(r["n"] for r in own)], options, [other, *weights],
        (sum(totals), Fraction(other, other + sum(weights))),
    )
    named = named.withColumn("node", F.lit(-1))
    return leaves.unionByName(named), paths.unionByName(own_path), tree


def grouped(
    by_source: DataFrame, sources: int, options: Options, stage: kit.Stage
) -> tuple[DataFrame, DataFrame | None, list[int]]:
    """From (source, n): each source's group and queue in it (source, node, queue),
    the totals of each group and those above it (node, path) below the root, and the
    root's totals. Up to ``fan_out`` sources are the root's own queues."""
    spread, width = options.fan_out, 1
    if sources > spread:
        # Half full on average, so that a group by hash stays within about fan_out.
        width = -(-2 * sources // spread)
    node = F.pmod(F.xxhash64("source"), F.lit(width))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "source"))
    leaves = by_source.withColumn("node", node)
    leaves = stage.table(leaves.select("source", "node", "n", (rank - 1).alias("queue")), "leaves")
    level = totals_of(leaves)
    paths, height = None, 0
    while width > 1:
        level = stage.table(level, f"groups-{height}")
        here = level.select(F.col("node").alias("at"), "totals")
        if paths is None:
            paths = here.select(F.col("at").alias("node"), F.array("totals").alias("path"))
        else:
            paths = paths.join(
                here, F.expr(f"node div {spread**height}") == F.col("at")
            ).select("node", F.concat("path", F.array("totals")).alias("path"))
        above = level.select(
            F.expr(f"node div {spread}").alias("node"), (F.col("node") % spread).alias("queue"), "n"
        )
        level, width, height = totals_of(above), -(-width // spread), height + 1
    # One row of at most about fan_out numbers.
    return leaves.drop("n"), paths, level.first()["totals"]


def totals_of(queues: DataFrame) -> DataFrame:
    """(node, totals, n) from (node, queue, n), zero where a queue is missing."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("queue").cast("int"), "n")))
    return queues.groupBy("node").agg(
        pairs.alias("pairs"), F.max("queue").cast("int").alias("last"), F.sum("n").alias("n")
    ).select(
        "node",
        F.transform(
            F.sequence(F.lit(0), F.col("last")), lambda q: F.coalesce(F.col("pairs")[q], F.lit(0))
        ).alias("totals"),
        "n",
    )


PIECE = (
    "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source",
)


def _schema(df: DataFrame, id_col: str, with_ids: bool) -> str:
    key = df.schema[id_col].dataType.simpleString()
    return (
        f"`{id_col}` {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, source string" + ", ids array<int>" * with_ids
    )


def _pieces(batch: pa.RecordBatch, tree: Tree, with_ids: bool) -> pa.RecordBatch:
    counts, found, checks, whole_tokens, pieces_ids = [], [np.zeros((4, 0), np.int64)], [], [], []
    names = ("path", "node", "queue", "place", "tokens", "ids")
    for path, node, queue, place, tokens, raw in zip(*(batch.column(n).to_pylist() for n in names)):
        ids = np.frombuffer(raw, f"<u{len(raw) // tokens}").astype("<u4")
        whole = memoryview(ids.tobytes())
        pieces = tree.cut(path or [], node, queue, place, tokens)
        bounds = list(zip(pieces[0].tolist(), (pieces[0] + pieces[1]).tolist()))
        checks += [zlib.crc32(whole[4 * begin : 4 * end]) for begin, end in bounds]
        if with_ids:
            pieces_ids += [ids[begin:end].astype(np.int32) for begin, end in bounds]
        found.append(pieces)
        counts.append(len(bounds))
        whole_tokens.append(tokens)
    start, size, window, offset = np.concatenate(found, 1)
    counts = np.array(counts, np.int64)
    all_tokens = np.repeat(np.array(whole_tokens, np.int64), counts)
    values = (start, size, np.array(checks, np.int64), all_tokens, window, offset)
    take = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
    arrays = [batch.column("key").take(take), *map(pa.array, values), batch.column("source").take(take)]
    if with_ids:
        arrays.append(pa.array(pieces_ids, pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])
