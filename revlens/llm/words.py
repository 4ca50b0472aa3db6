"""Words of whole texts as arrays, with 64-bit hashes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Longer words are hashed one by one.
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(lower: bool) -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
    if lower:
        out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


_PLAIN, _LOWER = _letters(False), _letters(True)


@dataclass
class Words:
    """Words in order; ``owner`` is the number of a word's text, and ``first``
    has the number of each text's first word, and of the end."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def slice(self, begin: int, end: int) -> list[bytes]:
        """The words of a range, as they stand in the text."""
        if begin >= end:
            return []
        return self.data[self.start[begin] : self.end[end - 1]].split()


def words_of(texts: list[str], lower: bool = False) -> Words:
    """Words of ASCII blanks' making; ``lower`` hashes A-Z like a-z."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw)
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~SPACE[codes]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(start, begins[: len(raw) + 1])
    first[-1] = len(start)
    owner = np.repeat(np.arange(len(raw)), np.diff(first))
    letters = _LOWER if lower else _PLAIN
    size = end - start
    hashed = size.astype(np.uint64)
    live = np.flatnonzero(size <= _LONG)
    for k in range(_LONG):
        live = live[size[live] > k]
        if not len(live):
            break
        hashed[live] = hashed[live] * _FACTOR + letters[codes[start[live] + k]]
    hashed = mix(hashed)
    for k in np.flatnonzero(size > _LONG):
        word = data[start[k] : end[k]]
        word = word.lower() if lower else word
        hashed[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return Words(data, start, end, owner, first, hashed)


def run_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` neighbours."""
    size = max(len(hashes) - length + 1, 0)
    out = np.full(size, length, np.uint64)
    for k in range(length):
        out = out * _FACTOR + hashes[k : k + size]
    return mix(out)


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
_BACK = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


def range_hash(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of ``hashes``, wherever it stands."""
    global _powers, _inverses
    if len(_powers) < len(hashes) + 1:
        steps = np.full(2 * len(hashes) + 1, _FACTOR)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps = np.full(2 * len(hashes) + 1, _BACK)
        steps[0] = 1
        _inverses = np.cumprod(steps)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers[: len(hashes)], out=sums[1:])
    found = (sums[end] - sums[begin]) * _inverses[begin]
    return mix(found + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_keys(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text. Rows that repeat both share
    them, and whatever is found for one holds for the other."""
    missing = F.col(id_col).isNull()
    parts = (F.col(id_col), F.col(text_col), missing)
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
