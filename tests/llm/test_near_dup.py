import random

import numpy as np
import pytest

from revlens.llm import near_dup as N
from revlens.llm.graph import components
from revlens.llm.kit import Stage
from tests_llm_prose import sentences

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(ids, texts, n=2):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    group = {}
    for k in range(len(ids)):
        group.setdefault(top(k), []).append(ids[k])
    return sorted((ids[k], len(sets[k]), min(group[top(k)])) for k in range(len(ids)))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.random()}" if r.random() < share else w for w in text.split())


def found(df, options=N.Options()):
    out = N.near_duplicates(df, options)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())


@pytest.mark.parametrize("options", [N.Options(), N.Options(block=4, bucket_block=3)])
def test_equal_to_brute_force(make_docs, odd_texts, options):
    base = sentences(1, 200)
    texts = odd_texts + [edited(base, 0.03 + 0.004 * k, k) for k in range(25)]
    texts += [base, base.upper(), sentences(2), sentences(2), "one", "ONE"]
    ids = list(range(100, 100 + len(texts)))
    assert found(make_docs(texts, ids), options) == brute(ids, texts)


def test_whole_folder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert found(docs) == brute([r.doc_id for r in rows], [r.text for r in rows])


def test_one_of_each(make_docs):
    docs = make_docs([sentences(1), sentences(1), None, None, sentences(2), sentences(2)], ids=[3, 2, 1, None, None, None])
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(2, sentences(1)), (1, ""), (0, ""), (0, sentences(2)), (0, sentences(2))]
    )
    assert N.one_of_each(docs.where("false")).count() == 0


def test_first_of_each_keeps_one_row(make_docs):
    texts = [sentences(1)] * 3 + [edited(sentences(3, 200), 0.01, 1), sentences(3, 200)] + [sentences(2)] * 3
    texts += [sentences(4), sentences(5), sentences(6), sentences(6), None, None, ""]
    ids = [7, 7, 8, 9, 9, None, None, None, 7, 9, None, 6, 5, 5, None]
    docs = make_docs(texts, ids=ids)
    kept = N.first_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    near = [t for d, t in got if d == 9 and t != sentences(5)]
    assert len(near) == 1 and near[0] in texts[3:5]
    got.remove((9, near[0]))
    assert got == sorted(
        [(7, sentences(1)), (7, sentences(4)), (9, sentences(5)), (0, sentences(2)), (6, sentences(6)), (5, ""), (0, "")]
    )
    assert N.first_of_each(docs.where("false")).count() == 0


def test_estimates_follow_the_similarity():
    o = N.Options()
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common = int(1000 * share)
        union = r.integers(0, 2**63, 1000, dtype=np.uint64)
        apart = (1000 - common) // 2
        a, b = np.sort(union[: common + apart]), np.sort(np.r_[union[:common], union[common + apart :]])
        regs = N.sketches(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), o)
        got = N.estimates(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]), o)[0]
        assert abs(got - share) < 0.1


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, Stage(spark)).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
