"""Language identification by language-bitmask n-gram filters.

A Bloom filter whose slots hold one bit for each language (bit-sliced over
machine words) returns, for an n-gram, every language that has it. A language's
popcount over a text's n-grams is corrected for the false positives that its
fill predicts; the largest corrected count decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm import kit


@dataclass(frozen=True)
class Options:
    """``min_share`` bounds what is learned: a language keeps n-grams that make
    up at least this share of all its n-grams, so at most 1 / min_share of them."""

    orders: tuple[int, ...] = (3, 4)
    min_share: float = 1e-5
    slots_per_key: int = 16
    hashes: int = 3
    max_languages: int = 1024


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000
    )


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (hash, text number) of all n-grams of lower-cased letters,
    every run of other characters being one gap, with a gap at both ends."""
    low = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    joined = "\0" + "\0\0".join(low) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[~letters()[codes]] = 0
    owner = np.repeat(np.arange(len(low)), lengths + 2)
    gap = codes == 0
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (owner[1:] == owner[:-1]))
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    for n in orders:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + size]
        inside = owner[:size] == owner[n - 1 :]
        yield mix(h[inside]), owner[:size][inside]


class Filter:
    def __init__(self, languages: list[str], keys: np.ndarray, masks: np.ndarray, options: Options):
        """``masks``: (keys, words) of 64 languages each."""
        self.languages, self.options = languages, options
        slots = 1 << max(10, int(len(keys) * options.slots_per_key - 1).bit_length())
        narrow = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= t(0).nbytes * 8), np.uint64)
        self.rows = np.zeros((masks.shape[1], slots), narrow)
        for k in range(options.hashes):
            at = self.slot(keys, k)
            for word in range(masks.shape[1]):
                np.bitwise_or.at(self.rows[word], at, masks[:, word].astype(narrow))
        self.false_rate = self._bit_means(self.rows) ** options.hashes

    def slot(self, hashes: np.ndarray, k: int) -> np.ndarray:
        bits = np.uint64(self.rows.shape[1] - 1)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return ((hashes + np.uint64(k) * step) & bits).astype(np.int64)

    def _bit_means(self, rows: np.ndarray) -> np.ndarray:
        width = rows.dtype.itemsize * 8
        return np.array(
            [
                ((rows[l // width] >> rows.dtype.type(l % width)) & rows.dtype.type(1)).mean()
                for l in range(len(self.languages))
            ]
        )

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """(words, n-grams): the bitmask of languages that have each n-gram."""
        found = self.rows[:, self.slot(hashes, 0)]
        for k in range(1, self.options.hashes):
            found &= self.rows[:, self.slot(hashes, k)]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        count = len(texts)
        seen = np.zeros((len(self.languages), count))
        total = np.zeros(count)
        for hashes, owner in grams(texts, self.options.orders):
            total += np.bincount(owner, minlength=count)
            found = self.languages_of(hashes)
            width = found.dtype.itemsize * 8
            for l in range(len(self.languages)):
                bit = (found[l // width] >> found.dtype.type(l % width)) & found.dtype.type(1)
                seen[l] += np.bincount(owner[bit.astype(bool)], minlength=count)
        rate = self.false_rate[:, None]
        true = np.maximum((seen - total * rate) / np.maximum(1 - rate, 1e-9), 0)
        best = true.argmax(0) if len(true) else np.zeros(count, int)
        sums = true.sum(0)
        score = np.where(sums > 0, true.max(0, initial=0) / np.maximum(sums, 1e-9), 0.0)
        known = letters()
        names = []
        for row, text in enumerate(texts):
            has = any(known[ord(c)] for c in text)
            names.append(self.languages[best[row]] if has and self.languages else "und")
        score[[n == "und" for n in names]] = 0.0
        return names, np.clip(score, 0, 1)


COUNTS = "lang string, gram bigint, n bigint"
FLUSH = 1 << 20


def count_grams(df: DataFrame, options: Options) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text), summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            keys, n = held.pop(lang)
            return kit.columns(lang=pa.array([lang] * len(keys), pa.string()), gram=keys.view(np.int64), n=n)

        for batch in batches:
            for part in kit.steps(batch, "text"):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), kit.texts_of(part)):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    keys, n = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    parts = [np.unique(h, return_counts=True) for h, _ in grams(texts, options.orders)]
                    all_keys = np.concatenate([keys, *(k for k, _ in parts)])
                    all_n = np.concatenate([n, *(c for _, c in parts)])
                    merged, where = np.unique(all_keys, return_inverse=True)
                    held[lang] = merged, np.bincount(where, all_n, len(merged)).astype(np.int64)
                    if len(merged) > FLUSH:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    counted = df.select("lang", "text").mapInArrow(run, COUNTS)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, options: Options = Options()) -> Filter:
    """Learn from rows of (lang, text); null languages are left out. What comes
    to the driver is bounded by 1 / min_share n-grams of each language."""
    known = df.where("lang is not null").select("lang", F.col("text").cast("string").alias("text"))
    counts = kit.Stage(df.sparkSession).table(count_grams(known, options), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all")).orderBy("lang")
    found = [r["lang"] for r in totals.limit(options.max_languages + 1).collect()]
    if len(found) > options.max_languages:
        raise ValueError(f"more than {options.max_languages} languages")
    shares = (
        counts.join(F.broadcast(totals), "lang")
        .withColumn("share", F.col("n") / F.col("all"))
        .where(F.col("share") >= options.min_share)
    )
    rows = shares.select("lang", "gram").toPandas()
    if rows.empty:
        return Filter(found, np.zeros(0, np.uint64), np.zeros((0, 1), np.uint64), options)
    number = rows["lang"].map({l: k for k, l in enumerate(found)}).to_numpy()
    keys, where = np.unique(rows["gram"].to_numpy().view(np.uint64), return_inverse=True)
    masks = np.zeros((len(keys), (len(found) + 63) // 64), np.uint64)
    np.bitwise_or.at(masks, (where, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    return Filter(found, keys, masks, options)


def identify(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row and whole text.

    Null texts and texts without a letter are ``und`` with score 0; equal counts
    go to the first language by name; null ids and repeated rows are kept as they
    are; other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, score = shared.value.predict(kit.texts_of(batch))
            return kit.columns(key=batch.column("key"), lang_pred=pa.array(names, pa.string()), score=score)

        return work

    key = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = kit.map_texts(narrow, make, f"key {key}, lang_pred string, score double")
    return out.withColumnRenamed("key", id_col)


def fold_is(id_col: str, folds: int, fold: int) -> Column:
    """Whether an id falls into a hash fold; a null id falls into none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
