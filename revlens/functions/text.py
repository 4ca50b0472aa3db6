"""Text column functions. Everything here runs inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from revlens.settings import BAD_TEXTS, LABEL_CODES, NEUTRAL_LABEL, SPACE_CHARS, STOPWORDS, TOKEN_PATTERN

_SPACE_RUN = f"[{SPACE_CHARS}]+"
# What is left of them after NFKC. A regular expression tries every class member
# on every letter, so the short list halves the time.
_SPACE_RUN_NFKC = "[ \t-\r\x1c-\x1f\x85\u1680\u2028\u2029]+"
_NON_SPACE = f"[^{SPACE_CHARS}]"
_LONGEST_BAD_TEXT = max(map(len, BAD_TEXTS))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Spark has no built-in, but ICU is on its class path, so
    ``java_method`` reaches it without sending the text to Python. ASCII text is
    what it is in NFKC, and most texts of many corpora need no call."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), plain, F.lit(True)
    )
    return F.when(plain.rlike("[^\\x00-\\x7f]"), composed).otherwise(plain)


def normalize_text(text: Column) -> Column:
    """NULL becomes ``''``; NFKC; white-space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(nfkc(text), _SPACE_RUN_NFKC, " "))


def normalize_name(name: str) -> str:
    """The same for a column header, on the driver."""
    import unicodedata

    return re.sub(_SPACE_RUN, " ", unicodedata.normalize("NFKC", name)).strip(" ")


def has_text(text: Column) -> Column:
    """True if ``normalize_text`` would give a non-empty value. It stops at the
    first visible character, so no text is normalised only to test it."""
    return F.coalesce(text.cast("string").rlike(_NON_SPACE), F.lit(False))


def normalize_label(label: Column) -> Column:
    """Canonical label name in any letter case; other values pass through."""
    known = F.create_map(
        *[F.lit(v) for name in (*LABEL_CODES, NEUTRAL_LABEL) for v in (name.lower(), name)]
    )
    clean = normalize_text(label)
    return F.coalesce(F.try_element_at(known, F.lower(clean)), clean)


def label_code(label_name: Column) -> Column:
    codes = F.create_map(*[F.lit(v) for pair in LABEL_CODES.items() for v in pair])
    return F.try_element_at(codes, label_name)


def label_title(code: Column) -> Column:
    names = F.create_map(*[F.lit(v) for n, c in LABEL_CODES.items() for v in (c, n)])
    return F.try_element_at(names, code)


def is_bad_text(text: Column) -> Column:
    """Placeholder values. Long texts fail the length test and are not lowered."""
    return (F.length(text) <= _LONGEST_BAD_TEXT) & F.lower(text).isin(*BAD_TEXTS)


def _words(text: Column, normalized: bool) -> Column:
    source = text if normalized else nfkc(text)
    return F.regexp_extract_all(source, F.lit(TOKEN_PATTERN), F.lit(0))


def tokens(
    text: Column,
    *,
    min_len: int = 2,
    stopwords: Sequence[str] | None = None,
    normalized: bool = False,
) -> Column:
    """Lower-cased word tokens. ``normalized`` says that the text has already
    been through ``normalize_text``."""
    words = F.transform(_words(text, normalized), F.lower)
    if min_len > 1:
        words = F.filter(words, lambda w: F.length(w) >= min_len)
    return drop_stopwords(words, stopwords) if stopwords else words


def drop_stopwords(words: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Keep repeats, unlike ``array_except``. The list is a hash set at run time."""
    if not stopwords:
        return words
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def dedupe_key(text: Column, *, normalized: bool = False) -> Column:
    """All tokens of any length, joined by a space."""
    return F.lower(F.array_join(_words(text, normalized), " "))


def key_digest(key: Column) -> Column:
    """32 bytes that stand for a key of any length in a shuffle."""
    return F.unhex(F.sha2(key, 256))


def with_bigrams(words: Column) -> Column:
    """Unigrams followed by adjacent pairs ``"a b"``. ``words`` should be a
    column, since it is used more than once."""
    return F.concat(words, bigrams(words))


def bigrams(words: Column) -> Column:
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), pairs),
        F.slice(words, F.lit(2), pairs),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def is_meaningful(term: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Some word of the term has three letters or more and is no stopword."""
    def content_word(word: Column) -> Column:
        long_enough = F.length(word) >= 3
        return long_enough & ~word.isin(*stopwords) if stopwords else long_enough

    return F.exists(F.split(term, " "), content_word)


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_.-]+", "__")
