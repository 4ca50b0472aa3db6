import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.functions import vectors as V
from revlens.settings import SPACE_CHARS, STOPWORDS, TOKEN_PATTERN

STRINGS = [
    None,
    "",
    "   ",
    "  ",
    "Enak sekali",
    "a-b-c d'e'f",
    "naïve café × ÷ x×y",
    "ﬁlter ＡＢＣ ½ ① Å K",
    "İstanbul Ÿou ẞ",
    "one\x1ctwo\x1dthree\x85four five six　seven",
    "".join(SPACE_CHARS) + "x" + SPACE_CHARS,
    "café résumé",
    "tab\tand\nnew\r\nline",
    "UPPER lower MiXed --x-- 'q'",
    "123 4five 6 日本語",
]


def py_normalize(value):
    if value is None:
        return ""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip()


def py_tokens(value, min_len=2):
    found = [m.group(0).lower() for m in re.finditer(TOKEN_PATTERN, py_normalize(value))]
    return [t for t in found if len(t) >= min_len]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id int, text string")


def column(spark, values, expr):
    rows = frame(spark, values).select("row_id", expr.alias("v")).orderBy("row_id").collect()
    return [r.v for r in rows]


def test_normalize_text(spark):
    got = column(spark, STRINGS, X.normalize_text(F.col("text")))
    assert got == [py_normalize(s) for s in STRINGS]


def test_every_space_character(spark):
    values = [f"a{c}b{c}{c}" for c in SPACE_CHARS]
    got = column(spark, values, X.normalize_text(F.col("text")))
    assert got == ["a b"] * 29
    blank = column(spark, list(SPACE_CHARS), X.has_text(F.col("text")))
    assert blank == [False] * 29


def test_has_text_is_not_blank_after_normalizing(spark):
    got = column(spark, STRINGS, X.has_text(F.col("text")))
    assert got == [py_normalize(s) != "" for s in STRINGS]


def test_tokens(spark):
    for min_len in (1, 2, 3):
        got = column(spark, STRINGS, X.tokens(F.col("text"), min_len=min_len))
        assert got == [py_tokens(s, min_len) for s in STRINGS]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=200, max_size=300))
def test_tokens_on_arbitrary_text(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    # Characters newer than one of the two Unicode versions may differ.
    values = [v for v in values if all(unicodedata.category(c) != "Cn" for c in v)]
    assert column(spark, values, X.tokens(F.col("text"))) == [py_tokens(v) for v in values]
    assert column(spark, values, X.normalize_text(F.col("text"))) == list(map(py_normalize, values))


def test_dedupe_key(spark):
    got = column(spark, STRINGS, X.dedupe_key(F.col("text")))
    assert got == [" ".join(py_tokens(s, 1)) for s in STRINGS]


def test_stopwords_keep_repeats(spark):
    words = column(spark, ["yang enak enak the tempat"], X.tokens(F.col("text"), stopwords=STOPWORDS))
    assert words == [["enak", "enak"]]


@pytest.mark.parametrize(
    "text, terms",
    [
        ("satu dua tiga", ["satu", "dua", "tiga", "satu dua", "dua tiga"]),
        ("satu", ["satu"]),
        ("", []),
    ],
)
def test_bigrams(spark, text, terms):
    df = frame(spark, [text]).withColumn("w", X.tokens(F.col("text")))
    assert df.select(X.with_bigrams(F.col("w"))).first()[0] == terms


def test_labels(spark):
    names = [" POSITIF", "negatif\n", "NeTral", "campuran ", None, "ｐｏｓｉｔｉｆ"]
    got = column(spark, names, X.normalize_label(F.col("text")))
    assert got == ["Positif", "Negatif", "Netral", "campuran", "", "Positif"]
    assert column(spark, ["Positif", "Negatif", "x"], X.label_code(F.col("text"))) == [1, 0, None]


def test_bad_text(spark):
    values = ["", "X", "-", ".", "N/A", "Na", "None", "NULL", "nan", "xx", "enak"]
    got = column(spark, values, X.is_bad_text(F.col("text")))
    assert got == [True] * 8 + [False] * 3


def test_meaningful_terms(spark):
    values = ["tidak terlalu", "di jakarta", "di dan", "yang", "ab", "ab enak"]
    got = column(spark, values, X.is_meaningful(F.col("text")))
    assert got == [True, True, False, False, False, True]


def test_slug(spark):
    values = ["indobenchmark/indobert-base-p1", "a  b//c", "x_y.z-1"]
    got = column(spark, values, X.slug(F.col("text")))
    assert got == ["indobenchmark__indobert-base-p1", "a__b__c", "x_y.z-1"]


def test_header_names():
    assert X.normalize_name("  text \nTranslated ") == "text Translated"


def test_score_functions(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],), ([2.0, 2.0],), ([-5.0, -1000.0],)], "a array<double>")
    rows = df.select(V.softmax(F.col("a")).alias("p"), V.argmax(F.col("a")).alias("i")).collect()
    assert rows[0].p == pytest.approx([0.268941421, 0.731058579])
    assert [r.i for r in rows] == [1, 0, 0]
    assert all(sum(r.p) == pytest.approx(1.0) for r in rows)
