import math
from collections import Counter

import pytest

from revlens.operators import terms as TM
from revlens.settings import TfidfOptions
from tests.test_text import py_tokens

TEXTS = ["enak enak sekali", "tidak enak sekali", "mahal tidak enak", "a", "", "sekali mahal mahal mahal"]


def py_terms(text):
    words = py_tokens(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_stats(texts):
    tf, df = Counter(), Counter()
    for text in texts:
        terms = py_terms(text)
        tf.update(terms)
        df.update(set(terms))
    return tf, df


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, i % 3 + 1, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "row_id long, fold int, text string")


def test_term_stats(docs):
    tf, df = brute_stats(TEXTS)
    got = {r.term: (r.tf, r.df) for r in TM.term_stats(TM.with_terms(docs)).collect()}
    assert got == {t: (tf[t], df[t]) for t in tf}


def test_vocabulary_cap_and_index(docs):
    options = TfidfOptions(max_features=3, min_df=2)
    rows = TM.vocabulary(TM.with_terms(docs), len(TEXTS), options).orderBy("idx").collect()
    tf, df = brute_stats(TEXTS)
    best = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:3]
    assert [r.term for r in rows] == sorted(best)
    assert [r.idx for r in rows] == [0, 1, 2]
    for r in rows:
        assert r.idf == pytest.approx(math.log((1 + len(TEXTS)) / (1 + df[r.term])) + 1)


def test_weights(docs):
    options = TfidfOptions(max_features=100, min_df=2)
    vocab = TM.vocabulary(TM.with_terms(docs), len(TEXTS), options)
    idf = {r.term: r.idf for r in vocab.collect()}
    got = {(r.row_id, r.term): r.weight for r in TM.weigh(docs, vocab).collect()}
    want = {}
    for i, text in enumerate(TEXTS):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in Counter(py_terms(text)).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        want.update({(i, t): w / norm for t, w in raw.items()})
    assert got == pytest.approx(want)


def test_fold_stats_leave_the_fold_out(docs):
    got = {
        (r.fold, r.term): (r.tf, r.df)
        for r in TM.fold_term_stats(TM.with_terms(docs), 3).collect()
    }
    want = {}
    for fold in (1, 2, 3):
        tf, df = brute_stats([t for i, t in enumerate(TEXTS) if i % 3 + 1 != fold])
        want.update({(fold, t): (tf[t], df[t]) for t in tf})
    assert got == want


def test_fold_vocabularies(docs):
    options = TfidfOptions(max_features=2, min_df=1)
    rows = TM.fold_vocabularies(TM.with_terms(docs), 3, options).collect()
    for fold in (1, 2, 3):
        train = [t for i, t in enumerate(TEXTS) if i % 3 + 1 != fold]
        tf, df = brute_stats(train)
        best = sorted(tf, key=lambda t: (-tf[t], t))[:2]
        here = {r.term: r.idf for r in rows if r.fold == fold}
        assert sorted(here) == sorted(best)
        for t, idf in here.items():
            assert idf == pytest.approx(math.log((1 + len(train)) / (1 + df[t])) + 1)


def test_only_frequent_terms_are_ranked(spark):
    """The least tf keeps ties, and terms of other folds do not count."""
    rows = [(1, "a", 5), (1, "b", 3), (1, "c", 3), (1, "d", 1), (2, "a", 1), (2, "b", 1)]
    stats = spark.createDataFrame(rows, "fold int, term string, tf long")
    least = {r.fold: r.least for r in TM._least_tf(stats, 2).collect()}
    assert least == {1: 3, 2: 1}
    assert {r.fold: r.least for r in TM._least_tf(stats, 4).collect()} == {1: 1, 2: 1}
