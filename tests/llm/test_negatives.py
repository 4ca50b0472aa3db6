import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revlens.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block string, shard string, score string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "r", "b", "s", "x") for r in rows], SCHEMA)


def takes_part(r):
    return None not in r and all(c is not None and math.isfinite(c) for c in r[1])


def brute(rows, anchor, o=N.Options(), scale=256):
    known = [
        (i, [math.floor(scale * float(np.float32(c))) for c in x], label)
        for i, x, label in filter(takes_part, rows)
    ]
    out = []
    for a, (i, x, label) in enumerate(known):
        if not anchor(i):
            continue
        scored = [
            (-sum(p * q for p, q in zip(x, y)), j, b, m) for b, (j, y, m) in enumerate(known) if b != a
        ]
        scored.sort()
        for s, j, _, _ in [r for r in scored if r[3] == label][: o.positives]:
            window = [
                r for r in scored if r[3] != label and o.low * -s <= 100 * -r[0] <= o.high * -s
            ]
            for rank, r in enumerate(window[: o.negatives], start=1):
                out.append((i, j, rank, r[1], -s, -r[0]))
    return sorted(out)


def found(df, anchor, **sizes):
    return sorted(map(tuple, N.mine(df, anchor, options=N.Options(**sizes)).collect()))


def cloud(seed, n, width=8, labels=4):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = draw.randrange(labels)
        out.append((i, [c + draw.gauss(0, 0.8) for c in centers[label]], label))
    return out


def odd_rows():
    rows = cloud(1, 300)
    same = rows[10][1]
    rows += [(1000 + k, same, 1 + k % 2) for k in range(60)]  # one vector of two labels
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[6][1], 0)]  # repeated ids
    rows += [
        (2000, None, 1), (2001, [1.0, None] + [0.5] * 6, 1), (2002, [float("nan")] * 8, 1),
        (2003, [float("inf")] + [0.1] * 7, 1), (2004, [0.5] * 8, None), (None, [0.5] * 8, 1),
        (2005, [], 1), (2010, [0.9, 0.4], 2), (2015, [0.0] * 8, 3), (2020, [0.3] * 8, 77),
    ]
    return rows


SIZES = [{}, {"block_anchors": 7, "shard_rows": 40, "pivots": 5, "blocks_at_once": 2}]


@pytest.mark.parametrize("sizes", SIZES)
def test_equal_to_brute_force(spark, sizes):
    rows = odd_rows()
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 400
    assert found(make(spark, rows), F.col("vec_id") % 5 == 0, **sizes) == want


def test_whole_folder(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    assert found(df, F.col("vec_id") % 50 == 0, block_anchors=4, shard_rows=64) == want


def test_no_anchors_no_positives_no_rows(spark):
    df = make(spark, [(1, [1.0, 0.0], 1), (2, [0.7, 0.0], 2), (3, [0.5, 0.0], 3)])
    every = F.lit(True)
    assert found(df, every) == found(df, F.col("vec_id") == 9) == found(df.where("false"), every) == []


def test_window_ends_belong_to_it(spark):
    """Positive score 100 x 100; 95 and 50 hundredths of it lie inside."""
    x = lambda v: [v / 256.0 + 1e-6]
    rows = [(0, x(100), 1), (1, x(100), 1), (2, x(95), 2), (3, x(96), 2), (4, x(50), 2), (5, x(49), 2)]
    df = make(spark, rows)
    got = found(df, F.col("vec_id") == 0)
    assert got == [(0, 1, 1, 2, 10000, 9500), (0, 1, 2, 4, 10000, 5000)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 25), st.integers(1, 6))
def test_tree_spans_at_least_length(seed, n, width):
    draw = np.random.default_rng(seed)
    x = draw.integers(-5, 5, (n, width))
    order, parent, edge = N.spanning_tree(x)
    assert sorted(order) == list(range(n)) and (parent == -1).sum() == 1
    place = {int(k): at for at, k in enumerate(order)}
    assert all(place[int(parent[k])] < place[k] for k in range(n) if parent[k] >= 0)
    # Kruskal
    pairs = sorted((float(np.linalg.norm(x[a] - x[b])), a, b) for a in range(n) for b in range(a))
    group, total = list(range(n)), 0.0
    for d, a, b in pairs:
        if group[a] != group[b]:
            total += d
            old = group[a]
            group = [group[b] if g == old else g for g in group]
    assert abs(total - edge.sum()) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_intervals_hold_the_scores_and_save_work(seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(-200, 200, (3, 12))
    anchors = np.repeat(base, 6, 0) + draw.integers(-2, 3, (18, 12))
    candidates = draw.integers(-200, 200, (80, 12))
    order, parent, edge = N.spanning_tree(anchors)
    at = np.empty(18, np.int64)
    at[order] = np.arange(18)
    anchors, parent, edge = anchors[order], np.where(parent >= 0, at[parent], -1)[order], edge[order]
    exact = anchors @ candidates.T
    scored = 0

    def wanted(a, low, high):
        assert (low <= exact[a]).all() and (exact[a] <= high).all()
        return high >= 60_000

    for a, need, scores in N.walk(anchors, parent, edge, candidates, wanted):
        assert (scores == exact[a, need]).all()
        assert set(np.flatnonzero(exact[a] >= 60_000)) <= set(need)
        scored += len(need)
    assert scored < 18 * 80 * 0.8


def test_pairs_are_dropped_before_vectors_move(spark, monkeypatch):
    """Two far clouds: blocks of one do not meet shards of the other."""
    draw = random.Random(3)
    rows = []
    for i in range(400):
        side, label = i % 2, i % 4  # labels 0 and 2 on one side, 1 and 3 on the other
        rows.append((i, [draw.gauss(1, 0.01) * (1 if k == side else 0.001) for k in range(2)], label))
    met = []
    plain = N._meet

    def spied(anchors, vectors, pairs, *rest):
        met.append((pairs.count(), anchors.select("block").distinct().count(), vectors.select("shard").distinct().count()))
        return plain(anchors, vectors, pairs, *rest)

    monkeypatch.setattr(N, "_meet", spied)
    o = {"block_anchors": 10, "shard_rows": 25, "pivots": 16}
    got = found(make(spark, rows), F.col("vec_id") % 5 == 0, **o)
    assert got == brute(rows, lambda i: i % 5 == 0)
    for pairs, blocks, shards in met:
        assert pairs <= 0.6 * blocks * shards
