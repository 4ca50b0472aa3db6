from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from revlens.llm import substring as S
from revlens.llm.fm_index import FMIndex
from tests_llm_prose import sentences


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((len(w), sum(gone), kept))
    return out


def found(df, options=S.Options()):
    out = S.remove_repeats(df, options).select("row.doc_id", "n_words", "n_removed", "kept")
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect())


def expected(texts, window=35):
    return sorted((k, *b) for k, b in enumerate(brute(texts, window)))


def corpus():
    shared = sentences(1, 60)
    return [
        sentences(2) + " " + shared + " " + sentences(3),
        shared + " " + sentences(4),
        sentences(5, 30) + " " + shared.replace("the", "THE", 1),
        sentences(6),
        sentences(6),
        " ".join(sentences(7, 40).split() * 3),
        " ".join(["again"] * 200),
        sentences(8, 34),
        sentences(8, 34),
    ]


@pytest.mark.parametrize("options", [S.Options(), S.Options(shard_words=300, hot_segments=1)])
def test_equal_to_brute_force(make_docs, odd_texts, options):
    texts = corpus() + odd_texts
    assert found(make_docs(texts), options) == expected(texts)


def test_whole_folder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 35)))
    assert found(docs) == want


def test_rows_repeating_id_and_text_and_null_ids(make_docs):
    docs = make_docs([sentences(1)] * 3 + [sentences(2)] * 2, ids=[7, 7, 8, None, None])
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.collect()] == [""] * 5


def test_many_rows_repeating_id_and_text(make_docs, monkeypatch):
    # Their passages also stand with other neighbours, so that shards see them.
    text, rows = sentences(1, 600), 5_000
    other = sentences(2, 20) + " " + " ".join(text.split()[100:300]) + " " + sentences(3, 20)
    cut = []
    table = S.kit.Stage.table

    def spy(self, df, name, *more):
        out = table(self, df, name, *more)
        if name == "passages":
            cut.append(out.where("copies > 1").count())
        return out

    monkeypatch.setattr(S.kit.Stage, "table", spy)
    docs = make_docs([text] * rows + [other, sentences(4)], ids=[7] * rows + [8, 9])
    got = S.remove_repeats(docs).groupBy("row.doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(7, 600, 600, rows), (8, 240, 200, 1), (9, 120, 0, 1)}
    assert 0 < cut[0] < 600


def test_hot_passage_fills_no_shard(make_docs, monkeypatch):
    shared = sentences(1, 45).split()[:45]
    texts = [" ".join([f"a{k}", f"b{k}", *shared, f"c{k}", f"d{k}"]) for k in range(300)]
    texts += [" ".join(shared[:35]), sentences(4) + " " + sentences(5, 40)]
    held = []
    table = S.kit.Stage.table

    def spy(self, df, name, *more):
        out = table(self, df, name, *more)
        if name == "passages":
            sizes = out.where("words IS NOT NULL").groupBy("shard").count().collect()
            held.append(max((r["count"] for r in sizes), default=0))
        return out

    monkeypatch.setattr(S.kit.Stage, "table", spy)
    options = S.Options(hot_segments=5, shard_words=300)
    assert found(make_docs(texts), options) == expected(texts)
    assert held[0] < 50


def test_untouched_texts_keep_their_blanks(make_docs):
    text = "two  blanks\tand a tab\n" + sentences(3)
    assert [r.text for r in S.without_repeats(make_docs([text, None])).orderBy("doc_id").collect()] == [text, None]


def test_empty_table(make_docs):
    assert S.without_repeats(make_docs(["a"]).where("false")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6))
def test_matching_statistics(sequences):
    lists = [np.array(s, np.int64) for s in sequences]
    index = FMIndex(lists, np.ones(len(lists), np.int64), 4)
    symbols = np.concatenate(lists)
    texts = ["".join(map(str, s)) for s in sequences]

    def count(pattern):
        return sum(
            t[k : k + len(pattern)] == pattern for t in texts for k in range(len(t) - len(pattern) + 1)
        )

    at = 0
    for t in texts:
        for end in range(len(t)):
            got = index.matches(symbols, np.array([at + end]), min(5, end + 1), 2)[0]
            want = max(
                (n for n in range(1, min(5, end + 1) + 1) if count(t[end + 1 - n : end + 1]) >= 2),
                default=0,
            )
            assert got == want
        at += len(t)
