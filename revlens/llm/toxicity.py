"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon (words and word stems with their weights) is learned from labelled
texts. To look a word up, the nondeterministic Levenshtein automaton of the word (one
edit), held as one bit set for each number of edits, runs along the trie's branch
of the word's first letter; a branch ends when no state is left, so misspelled
terms are found without listing them. Where the one edit falls on the first
letter, nothing after it differs, so those terms are looked up as they stand.

A hit inside a quotation counts apart from a hit in the writer's own voice, and a
hit near an address (a second person) apart from others. A logistic regression
over these sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm import kit
from revlens.llm.bpe import TwoGenerations

# Marks that open or close a quotation, and second persons.
QUOTES = "\"“”„«»‘’"
ADDRESSED = frozenset("you your you're u du dich dir dein deine ihr euch tu te toi ton vous votre usted tú ti".split())
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST = 3


def words_of(token: str) -> list[str]:
    """The words that a token without blanks may hold: itself without what stands
    around its letters, then its runs of letters if other signs part them."""
    whole = _EDGES.sub("", token)
    runs = [] if whole.isalpha() else _LETTERS.findall(whole)
    return [w for w in [whole, *(runs if len(runs) > 1 else [])] if len(w) >= SHORTEST]


@dataclass(frozen=True)
class Options:
    """``max_rows`` bounds the labelled rows that the lexicon and the regression
    are fitted on, ``max_terms`` the lexicon. All rows are scored."""

    max_rows: int = 10_000
    max_terms: int = 2_000
    min_toxic: int = 5
    min_log_odds: float = 3.0
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    window: int = 8
    ridge: float = 1.0


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    word: float | None = None
    stem: float | None = None
    depth: int = 0


def allowed(length: int) -> int:
    """Edits that a term of this length forgives."""
    return 0 if length < 4 else 1


class Lexicon:
    """A trie of words and stems (``stem*``) with weights."""

    def __init__(self, terms: dict[str, float]):
        self.root = Node()
        # Terms that forgive an edit, whole and without their first letter.
        self.words: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        self.word_tails: dict[str, float] = {}
        self.stem_tails: dict[str, float] = {}
        for term, weight in terms.items():
            body = term.rstrip("*")
            if allowed(len(body)):
                stem = term.endswith("*")
                whole, tails = (self.stems, self.stem_tails) if stem else (self.words, self.word_tails)
                whole[body] = weight
                tails[body[1:]] = max(weight, tails.get(body[1:], weight))
            node = self.root
            for ch in body:
                node = node.children.setdefault(ch, Node(depth=node.depth + 1))
            if term.endswith("*"):
                node.stem = weight
            else:
                node.word = weight
        self.stem_sizes = sorted({len(s) for s in self.stems})
        # No term reads a word beyond this: a longer word is like its beginning.
        self.reach = max((len(t.rstrip("*")) for t in terms), default=0) + 2

    def nearest(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term for a word: fewest edits, then most
        weight. A stem matches a word that goes on after it."""
        word = word[: self.reach]
        found = self.find(word)
        if found and not found[1]:
            return found
        weights = [found[0]] if found else []
        rest = word[1:]
        # The first letter replaced; left out of the word; one put before it.
        weights += [self.word_tails.get(rest), self.word_tails.get(word), self.words.get(rest)]
        for n in self.stem_sizes:
            if n <= len(word):
                weights.append(self.stem_tails.get(word[: n - 1]))
            if n < len(word):
                weights.append(self.stem_tails.get(word[1:n]))
            if n + 1 < len(word):
                weights.append(self.stems.get(word[1 : n + 1]))
        best = max((w for w in weights if w is not None), default=None)
        return None if best is None else (best, 1)

    def find(self, word: str) -> tuple[float, int] | None:
        """The same among the terms of the word's first letter, whose edit comes
        after it: one branch of the root."""
        branch = self.root.children.get(word[:1])
        if branch is None:
            return None
        place: dict[str, int] = {}
        for k, ch in enumerate(word[1:]):
            place[ch] = place.get(ch, 0) | 1 << k
        end = 1 << len(word) - 1
        every = (end << 1) - 1
        best: tuple[int, float] | None = None
        # Positions in the word that no edit, and one edit, can have reached.
        todo = [(branch, 1, 3 & every)]
        while todo:
            node, exact, edited = todo.pop()
            if node.word is not None or node.stem is not None:
                for e in range(allowed(node.depth) + 1):
                    states = edited if e else exact
                    for weight, hit in ((node.word, states & end), (node.stem, states & (end - 1))):
                        if weight is not None and hit:
                            best = min(best or (e, -weight), (e, -weight))
            for ch, child in node.children.items():
                match = place.get(ch, 0)
                on = (exact & match) << 1
                # a letter matched; one replaced; one of the term's left out; one
                # of the word's left over
                off = ((edited & match) << 1 | exact << 1 | exact | on << 1) & every
                if on | off:
                    todo.append((child, on, off))
        return (-best[1], best[0]) if best else None


NONE: tuple = ()
FEATURES = 5


class Scorer:
    def __init__(self, lexicon: Lexicon, options: Options):
        self.lexicon, self.options = lexicon, options
        self.seen = TwoGenerations(200_000)

    def _look_up(self, tokens: list[str]) -> list[tuple]:
        return [self._hits(token) for token in tokens]

    def _hits(self, token: str) -> tuple:
        """(weight, edits) of the whole token, or of each of its words."""
        words = words_of(token)
        found = self.lexicon.nearest(words[0]) if words else None
        if len(words) == 1 or (found and not found[1]):
            return (found,) if found else NONE
        inner = tuple(hit for w in words[1:] if (hit := self.lexicon.nearest(w)))
        return inner or ((found,) if found else NONE)

    def features(self, text: str) -> list[float]:
        """Sums of weights: own voice exact, own voice misspelled, quoted,
        addressed; and the share of words that are hits."""
        tokens = text.lower().split()
        sums = [0.0] * FEATURES
        if not tokens:
            return sums
        hits = 0
        for at, found in enumerate(self.seen.get_all(tokens, self._look_up)):
            if not found:
                continue
            hits += 1
            near = tokens[max(0, at - self.options.window) : at + self.options.window + 1]
            in_quotes = quoted(tokens, at, self.options.window)
            addressed = not ADDRESSED.isdisjoint(near)
            for weight, edits in found:
                if in_quotes:
                    sums[2] += weight
                    continue
                sums[1 if edits else 0] += weight
                if addressed:
                    sums[3] += weight
        return [math.log1p(s) for s in sums[:4]] + [hits / len(tokens)]


def quoted(tokens: list[str], at: int, window: int) -> bool:
    """Whether a quotation opens at or before a word and closes at or after it,
    both within the window."""
    opened = False
    for token in tokens[max(0, at - window) : at + 1]:
        if token[0] in QUOTES:
            opened = True
        if token.rstrip(".,;:!?")[-1:] in QUOTES and token is not tokens[at]:
            opened = False
    return opened and any(
        t.rstrip(".,;:!?")[-1:] in QUOTES for t in tokens[at : at + window + 1]
    )


def terms_of(text: str, options: Options) -> set[str]:
    out = {w for t in set(text.lower().split()) for w in words_of(t)}
    return out | {w[:n] + "*" for w in out for n in options.stems if len(w) > n}


def learn_lexicon(df: DataFrame, options: Options) -> Lexicon:
    """From rows of (text, label): terms of strong log odds, a stem instead of
    the words it covers unless one word makes up most of it."""
    o = options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.steps(batch, "text"):
                counts = (Counter(), Counter())
                for text, label in zip(kit.texts_of(part), part.column("label").to_pylist()):
                    counts[label].update(terms_of(text, o))
                terms = list(counts[1]) + [t for t in counts[0] if t not in counts[1]]
                yield kit.columns(
                    term=pa.array(terms, pa.string()),
                    clean=pa.array([counts[0][t] for t in terms], pa.int64()),
                    toxic=pa.array([counts[1][t] for t in terms], pa.int64()),
                )

    sums = (
        df.select("text", "label")
        .mapInArrow(run, "term string, clean bigint, toxic bigint")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= o.min_toxic)
    )
    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    rows = (
        sums.withColumn("odds", odds)
        .where(F.col("odds") >= o.min_log_odds)
        .orderBy(F.desc("toxic"), F.desc("odds"), "term")
        .limit(o.max_terms)
        .collect()
    )
    found = {r["term"]: (r["toxic"], r["odds"]) for r in rows}
    words = {t for t in found if not t.endswith("*")}
    stems: dict[str, int] = {}
    for term in sorted(found.keys() - words, key=len, reverse=True):
        stem, count = term[:-1], found[term][0]
        inner = [found[w][0] for w in words if w.startswith(stem)]
        inner += [n for s, n in stems.items() if s.startswith(stem)]
        if max(inner, default=0) < 0.8 * count:
            stems = {s: n for s, n in stems.items() if not s.startswith(stem)} | {stem: count}
    covered = tuple(stems)
    chosen = {s + "*" for s in stems} | {w for w in words if not covered or not w.startswith(covered)}
    return Lexicon({t: found[t][1] for t in chosen})


def regress(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton's method; the intercept comes first."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    options: Options


def features(df: DataFrame, lexicon: Lexicon, options: Options) -> DataFrame:
    """(key, x) for rows (key, text)."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        scorer = Scorer(shared.value, options)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [scorer.features(t) for t in kit.texts_of(batch)]
            return kit.columns(key=batch.column("key"), x=pa.array(x, pa.list_(pa.float64())))

        return work

    key = df.schema["key"].dataType.simpleString()
    return kit.map_texts(df, make, f"key {key}, x array<double>")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    options: Options = Options(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on at most ``max_rows`` labelled rows, chosen by a hash of their id."""
    o = options
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = (
        known.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key", "label")
        .limit(o.max_rows)
    )
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    # At most max_rows ids.
    rows = texts.join(F.broadcast(chosen), "key")
    stage = kit.Stage(docs.sparkSession)
    rows = stage.table(rows, "labelled")
    lexicon = learn_lexicon(rows, o)
    found = features(rows.withColumn("key", F.col("label")), lexicon, o).toPandas()
    if found.empty:
        return Model(lexicon, np.zeros(FEATURES + 1), o)
    x = np.stack(found["x"].to_numpy())
    stage.drop(rows)
    return Model(lexicon, regress(x, found["key"].to_numpy(float), o.ridge), o)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row and whole text.

    A null or empty text has no hits and gets the score of a text without any;
    null ids and repeated rows are scored like any other; other columns are left
    out. Without labelled rows every score is 0.5.
    """
    narrow = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = features(narrow, model.lexicon, model.options)
    z = F.lit(float(model.weights[0]))
    for k, w in enumerate(model.weights[1:]):
        z = z + F.lit(float(w)) * F.col("x")[k]
    value = 1 / (1 + F.exp(-z))
    return found.select(F.col("key").alias(id_col), value.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
