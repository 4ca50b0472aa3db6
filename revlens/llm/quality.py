"""Quality rules: one Spark projection, compiled from a table of thresholds.

Every measure is a built-in Spark expression over one text, so nothing is
shuffled and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of the languages served.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "was", "on", "as", "by",
    "de", "la", "le", "les", "et", "des", "un", "une", "en", "que", "pour", "dans", "est",
    "el", "los", "las", "y", "por", "con", "una", "del", "se",
    "der", "die", "das", "und", "den", "ist", "von", "zu", "mit", "ein", "eine", "auf",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; an open end is None. A measure that
    is null (a ratio over nothing) passes."""

    name: str
    measure: Callable[[], Column]
    low: float | None = None
    high: float | None = None


def ratio(part: str, whole: str) -> Callable[[], Column]:
    return lambda: F.col(part) / F.when(F.col(whole) > 0, F.col(whole))


# The thresholds leave running text alone, and reject what has hardly any, or is
# mostly marks, shouting, separators or repeated lines.
RULES = (
    Rule("mean_word_chars", ratio("word_chars", "n_words"), 2, 40),
    Rule("symbols_per_word", ratio("n_symbols", "n_words"), None, 0.4),
    Rule("dup_line_share", ratio("n_dup_lines", "n_lines"), None, 0.5),
    Rule("upper_share", ratio("n_upper", "word_chars"), None, 0.5),
    Rule("stop_word_share", ratio("n_stop_words", "n_words"), 0.02, None),
    Rule("bar_share", ratio("n_bars", "n_words"), None, 0.25),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def removed(text: Column, pattern: str) -> Column:
    """Characters that ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, F.lit("")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more.

    Windows are compared by hash, equal neighbours in hash order by their words,
    so the time is n log n even where every window repeats.
    """
    count = F.greatest(F.size(words) - (window - 1), F.lit(0))

    def hashes() -> Column:
        return F.transform(
            F.sequence(F.lit(1), count), lambda p: F.xxhash64(F.slice(words, p, window))
        )

    def covered(placed: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (
                F.slice(words, a["p"], window) == F.slice(words, b["p"], window)
            )

        last = F.size(placed) - 1
        repeated = F.filter(
            placed,
            lambda x, k: ((k > 0) & same(x, F.get(placed, k - 1)))
            | ((k < last) & same(x, F.get(placed, k + 1))),
        )
        return let(
            F.array_sort(F.transform(repeated, lambda x: x["p"])),
            lambda at: F.aggregate(
                F.transform(
                    at,
                    lambda p, k: F.least(
                        F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))
                    ),
                ),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    def some(h: Column) -> Column:
        # Most texts repeat nothing; a hash set tells, without a sort.
        none = F.size(F.array_distinct(h)) == F.size(h)
        placed = F.array_sort(
            F.transform(h, lambda x, k: F.struct(x.alias("h"), (k + 1).alias("p")))
        )
        return F.when(none, F.lit(0).cast("long")).otherwise(let(placed, covered))

    return F.when(count < 2, F.lit(0).cast("long")).otherwise(let(hashes(), some))


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df``, of columns that no measure is named like, with a column of each
    measure; null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, lines = F.col("words"), F.col("lines")
    lower = F.transform(words, lambda w: F.lower(w))
    long = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, SPACES, F.lit(""))),
        "n_symbols": removed(text, r"[#*$%&|<>]"),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(words),
        "n_upper": removed(text, r"\p{Lu}"),
        "n_bars": removed(text, r"\|"),
        "n_stop_words": F.size(F.filter(lower, lambda w: w.isin(*STOP_WORDS))),
    }
    # A generator keeps later filters above it. Pushed down, they would put the
    # words' expression into every use of it, lambdas included.
    row = F.struct(*[v.cast("long").alias(k) for k, v in long.items()])
    return (
        df.withColumn("words", words_of(text))
        .withColumn("lines", F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
        .select(*df.columns, F.inline(F.array(row)))
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        for bound, passes in (
            (rule.low, lambda m, b: m >= b),
            (rule.high, lambda m, b: m <= b),
        ):
            if bound is not None:
                out = out & F.coalesce(passes(rule.measure(), bound), F.lit(True))
    return out


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < 20) | (100 * F.col("n_repeat_words") > 30 * words)


def quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """(id, measures, base_failed, kept) for every row.

    A null text is empty, has no words and fails; null ids and repeated rows are
    judged like any other; other columns are left out. The work grows with the
    length of a text (n log n where its windows repeat).
    """
    narrow = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return (
        measured(narrow)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
        .drop("text")
        .withColumnRenamed("key", id_col)
    )


def keep_good(
    df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The rows that pass, with their own columns only."""
    whole = df.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    kept = measured(whole).where(~base_failed() & verdict(rules))
    return kept.select("row.*")
