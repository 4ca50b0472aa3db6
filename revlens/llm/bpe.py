"""Byte-level BPE: encoding with a queue of merge ranks, decoding by strings.

The symbols of a word form a doubly linked list. A heap holds every mergeable
pair as (rank, position, left symbol, right symbol); an entry whose symbols have
changed since it was pushed is stale and skipped. Ties of rank go to the left.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from revlens.llm import kit

# Fixed value: the pattern that splits a text before any merge.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Parts of a text remembered in each of two generations of a task's memory.
MEMORY = 250_000
# Longer parts are encoded but not remembered.
LONGEST = 64


def byte_letters() -> dict[str, int]:
    """The letter by which vocabularies of this kind write each byte: printable
    Latin-1 bytes stand for themselves, the others follow from code 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TwoGenerations:
    """Remembers values of recent keys; holds at most two generations of them."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get_all(self, keys: list[str], make: Callable[[list[str]], list]) -> list:
        """The values of ``keys``; ``make`` gives those not remembered."""
        out = list(map(self.new.get, keys))
        if None not in out:
            return out
        empty = [at for at, v in enumerate(out) if v is None]
        missing = {keys[at] for at in empty}
        here = {k: v for k in missing if (v := self.old.get(k)) is not None}
        wanted = [k for k in missing if k not in here]
        here.update(zip(wanted, make(wanted)))
        for at in empty:
            out[at] = here[keys[at]]
        if max(map(len, here)) > LONGEST:
            here = {k: v for k, v in here.items() if len(k) <= LONGEST}
        if len(self.new) + len(here) > self.size:
            self.old, self.new = self.new, {}
        self.new.update(here)
        return out


def parts_of(text: str) -> list[str]:
    """The text cut before each space that a visible character follows. No token
    reaches across such a place, so parts can be encoded one by one."""
    plain = not any(map(text.__contains__, _RARE_ASCII))
    if plain and not text.isascii():
        plain = not any(map(text.__contains__, _RARE_OTHER))
    if plain and not text.endswith(" "):
        return text.replace(" ", "\0 ").split("\0")
    return _CUT.split(text)


# Where none of these occurs, every space is such a place.
_RARE_ASCII = ("\0", *(" " + chr(c) for c in (*range(9, 14), *range(28, 33))))
_RARE_OTHER = tuple(
    chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
# A place, not a character: the space stays with the part that follows.
_CUT = regex.compile(r"(?V1)(?= [^\s\x1c-\x1f])")


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocab, merges = described["model"]["vocab"], described["model"]["merges"]
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.strings = {i: raw[t] for t, i in vocab.items()}
        self.strings.update({i: t.encode() for t, i in self.special.items()})
        self.bytes = [0] * 256
        for token, number in vocab.items():
            if len(raw[token]) == 1:
                self.bytes[raw[token][0]] = number
        # (left, right) -> (rank, merged), both packed into one number each.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[left] << 32 | vocab[right]
            self.merges.setdefault(key, rank << 32 | vocab[left + right])
        names = sorted(self.special, key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = TwoGenerations(MEMORY)
        self.parts = TwoGenerations(MEMORY)

    def merge(self, word: str) -> bytes:
        """The ids of one word."""
        ids = [self.bytes[b] for b in word.encode()]
        size = len(ids)
        known = self.merges.get
        # An entry is rank and position in one number, so ties go to the left.
        heap = []
        for at in range(size - 1):
            found = known(ids[at] << 32 | ids[at + 1])
            if found is not None:
                heap.append(found >> 32 << 32 | at)
        if not heap:
            return array("I", ids).tobytes()
        heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        while heap:
            entry = heappop(heap)
            at = entry & 0xFFFFFFFF
            follow = after[at]
            if ids[at] < 0 or follow >= size:
                continue  # stale: the symbol or its neighbour is gone
            found = known(ids[at] << 32 | ids[follow])
            if found is None or found >> 32 != entry >> 32:
                continue  # stale: another pair stands here now
            merged = found & 0xFFFFFFFF
            ids[at], ids[follow] = merged, -1
            beyond = after[at] = after[follow]
            if beyond < size:
                before[beyond] = at
                found = known(merged << 32 | ids[beyond])
                if found is not None:
                    heappush(heap, found >> 32 << 32 | at)
            ahead = before[at]
            if ahead >= 0:
                found = known(ids[ahead] << 32 | merged)
                if found is not None:
                    heappush(heap, found >> 32 << 32 | ahead)
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        return list(map(self.merge, words))

    def _part(self, part: str) -> list[str | bytes]:
        """Words, and ids of special tokens, which are found before all else."""
        if part.isascii() and part[1:].isalpha() and part[0] == " ":
            return [part]
        if not any(name in part for name in self.special):
            return SPLIT.findall(part)
        out, at = [], 0
        for match in self.find_special.finditer(part):
            number = array("I", [self.special[match[0]]]).tobytes()
            out += [*SPLIT.findall(part[at : match.start()]), number]
            at = match.end()
        return out + SPLIT.findall(part[at:])

    def _parts(self, parts: list[str]) -> list[bytes]:
        split = list(map(self._part, parts))
        flat = [w for words in split for w in words if isinstance(w, str)]
        ids = iter(self.words.get_all(flat, self._words))
        return [
            b"".join([w if isinstance(w, bytes) else next(ids) for w in words]) for words in split
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers (all
        platforms that Spark runs its workers on are little-endian)."""
        cut = [parts_of(t) for t in texts]
        flat = self.parts.get_all([p for parts in cut for p in parts], self._parts)
        out, at = [], 0
        for parts in cut:
            out.append(b"".join(flat[at : at + len(parts)]))
            at += len(parts)
        return out

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        joined = b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return joined.decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker; its file is on every machine."""
    return Tokenizer(path)


def encode_decode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids, decoded) for every row; ids are little-endian unsigned 32-bit.

    A null text is empty and has no ids. Texts of any length are encoded whole;
    null ids and repeated rows are encoded like any other; other columns are left
    out.
    """
    fields = "ids binary, decoded string"
    return _mapped(df, path, id_col, text_col, fields, lambda ids, text: (ids, text))


def encode_digest(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``."""

    def digest(ids: bytes, text: str) -> tuple:
        return (
            len(ids) // 4,
            hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )

    return _mapped(
        df, path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest
    )


def _mapped(df, path, id_col, text_col, fields: str, result) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def make():
        own = tokenizer(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [result(ids, own.decode(ids)) for ids in own.encode(kit.texts_of(batch))]
            values = dict(zip(names, map(list, zip(*rows))))
            return kit.columns(key=batch.column("key"), **values)

        return work

    key = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return kit.map_texts(narrow, make, f"key {key}, {fields}").withColumnRenamed("key", id_col)
