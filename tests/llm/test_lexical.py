import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revlens.llm import lexical as L
from tests_llm_prose import sentences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 75 + (25 * n * n_docs) // total
            score = 0
            for t in split(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], start=1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=str)


def found(docs, items, **sizes):
    rows = L.search(docs, items, options=L.Options(**sizes)).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


def as_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x"))


@pytest.mark.parametrize("text", [None, "", "a--B9 c", "Größe ÄÖ x\u0085y 日本 😀_z", "\0a\x7fb[c]", "x" * 9000])
def test_terms(text):
    raw = None if text is None else text.encode()
    assert [t.decode() for t in L.terms(raw)] == split(text)


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 40, "first_depth": 1, "block_items": 2}])
def test_equal_to_brute_force(spark, make_docs, odd_texts, sizes):
    texts = odd_texts + [sentences(k, 20 + 9 * k) for k in range(40)] + [sentences(3, 47)] * 30
    items = [(k, sentences(k, 14)) for k in range(5)]
    items += [(10, "The THE the fox"), (11, ""), (12, None), (13, "qqqq zzzz"), (14, sentences(0, 14)), (15, "日本語")]
    want = brute(list(enumerate(texts)), items)
    assert len(want) > 100 and found(make_docs(texts), as_items(spark, items), **sizes) == want


def test_whole_folder(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute(
        [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    )
    assert found(docs, items) == want


def test_ties_repeats_and_null_ids(spark, make_docs):
    docs = make_docs(["red fox", "red fox", "red fox", "red fox", "blue"] * 6, [5, 3, None, 3, 8] * 6)
    rows = found(docs, as_items(spark, [(1, "red"), (1, "red")]), k=14)
    assert sorted(r[1] for r in rows) == sorted([*range(1, 15)] * 2)
    by_rank = sorted((r[1], r[2]) for r in rows)
    assert [i for _, i in by_rank[::2]] == [3] * 12 + [5] * 2
    assert len({r[3] for r in rows}) == 1


def test_no_rows(spark, make_docs):
    items, docs = as_items(spark, [(1, "red")]), make_docs(["red", None])
    none = found(docs.where("false"), items)
    assert none == found(docs, items.where("false")) == found(make_docs([None, "--"]), items) == []


def impact_lists(draw, n_docs, n_terms):
    cells = [(t, d) for t in range(n_terms) for d in range(n_docs) if draw.random() < draw.choice((0.1, 0.9))]
    cells.sort(key=lambda c: c[1])
    impact = [draw.randrange(1, 50) for _ in cells]
    term, doc = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
    return term, doc, np.array(impact, np.int64)


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([1, 2, 64]))
def test_best_positions_hold_the_best(seed, k, depth):
    draw = random.Random(seed)
    term, doc, impact = impact_lists(draw, draw.randrange(1, 60), draw.randrange(1, 6))
    times = np.array([draw.randrange(1, 3) for _ in range(7)], np.int64)
    total = Counter()
    for t, d, i in zip(term.tolist(), doc.tolist(), impact.tolist()):
        total[d] += int(times[t]) * i
    best = sorted(total.values(), reverse=True)[:k]
    floor = draw.choice([0, best[-1] if len(best) == k else 0])
    shard = L.Shard(term, doc, impact, int(doc.max(initial=0)) + 1)
    at, scores, _ = L.best_positions(shard, np.arange(7), times, k, floor, depth)
    assert all(total[d] == s for d, s in zip(at.tolist(), scores.tolist()))
    bar = max([floor, *best[k - 1 : k]])
    assert {d for d, s in total.items() if s >= bar} <= set(at.tolist())


def test_reading_stops_early():
    """One document leads all lists by far; the rest of them is not read."""
    n = 10_000
    doc = np.tile(np.arange(n), 3)
    order = np.argsort(doc, kind="stable")
    term = np.repeat(np.arange(3), n)[order]
    impact = np.where(doc == 77, 1000, 1 + (doc * 7) % 400)[order]
    shard = L.Shard(term, doc[order], impact, n)
    at, scores, read = L.best_positions(shard, np.arange(3), np.ones(3, np.int64), 1, 0, 16)
    assert (at.tolist(), scores.tolist()) == ([77], [3000]) and read < 200


def test_documents_do_not_move(spark, make_docs):
    texts = make_docs(["red fox"]).selectExpr("doc_id AS id", "text")
    words = spark.sparkContext.broadcast({b"red": 0})
    assert "Exchange" not in L.postings(texts, words)._jdf.queryExecution().executedPlan().toString()
