import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from revlens.llm import exact_dup as E

BLANK = re.compile(r"[\x20\x09-\x0D]")


def bare(text):
    return BLANK.sub("", text or "")


def brute(ids, texts):
    """(id, keep_id, group_size, kept) of rows with ids of their own."""
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in zip(ids, texts):
        group = groups[bare(t)]
        keep = min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
        out.append((i, keep, len(group), keep == i))
    return sorted(out, key=str)


def found(df, options=E.Options()):
    rows = E.mark(df, options=options).collect()
    return sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in rows), key=str)


def copies():
    words = "one two three four five six".split()
    return [sep.join(words) for sep in (" ", "  ", "\n", "\t ", "")] + ["one two", "onetwo ", "o ne two"]


# Small sizes: many shards, many combined runs, most groups through the shuffle join.
SMALL = E.Options(shard_keys=3, combine_keys=2, broadcast_groups=1)


@pytest.mark.parametrize("options", [E.Options(), SMALL])
def test_equal_to_brute_force(make_docs, odd_texts, options):
    texts = odd_texts + copies() + ["", None, "a" * 7, " ".join("a" * 7)]
    ids = list(range(100, 100 + len(texts)))
    assert found(make_docs(texts, ids), options) == brute(ids, texts)


@pytest.mark.parametrize("options", [E.Options(), SMALL])
def test_whole_folder(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert found(docs, options) == brute([r.doc_id for r in rows], [r.text for r in rows])


def test_digests_are_of_whole_texts(make_docs, odd_texts):
    for r in E.mark(make_docs(odd_texts)).collect():
        want = hashlib.sha256(bare(odd_texts[r.id]).encode()).digest()
        assert bytes(r.digest) == want and r.n_chars == len(odd_texts[r.id] or "")


def test_repeated_and_null_ids_keep_one_row(make_docs):
    rows = found(make_docs(["a b"] * 5 + ["c"], [7, 7, None, None, 9, None]))
    assert [r[:3] for r in rows] == sorted([(7, 7, 5)] * 2 + [(9, 7, 5)] + [(None, 7, 5)] * 2 + [(None, None, 1)], key=str)
    assert sorted((r[0], r[3]) for r in rows if r[3] and r[2] == 5) == [(7, True)]
    assert (None, None, 1, True) in rows


def test_string_ids_and_no_rows(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("", "z")], "doc_id string, text string")
    assert found(df) == [("", "", 1, True), ("a", "a", 2, True), ("b", "a", 2, False)]
    assert found(df.where("false")) == []


def test_hot_text_is_few_rows_before_the_shuffle(spark, make_docs):
    rows = E.rows_of(spark.range(40_000).selectExpr("id AS doc_id", "'same text' AS text"))
    assert E._changes(rows, E.shard_of(8), E.Options()).count() <= rows.rdd.getNumPartitions()


def key(n):
    return hashlib.sha256(str(n).encode()).digest()


def test_filter_resizes_from_its_keys():
    f = E.CuckooFilter()
    for n in range(5000):
        assert f.find(key(n)) == -1
        assert f.add(key(n)) == n
    assert f.resized >= 6
    assert [f.find(key(n)) for n in range(5000)] == list(range(5000))
    assert f.buckets * E.SLOTS <= 4 * 5000


def test_equal_fingerprints_are_told_apart():
    f = E.CuckooFilter()
    same = [key(0)[:8] + bytes([n]) * 24 for n in range(6)]  # one fingerprint, one bucket
    for n, k in enumerate(same):
        assert f.find(k) == -1
        f.add(k)
        assert [f.find(x) for x in same] == [m if m <= n else -1 for m in range(6)]
    f.remove(same[2])
    assert [f.find(x) for x in same] == [0, 1, -1, 3, 4, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_filter_is_a_set(steps):
    f, live = E.CuckooFilter(), set()
    for add, n in steps:
        if add and n not in live:
            f.add(key(n))
            live.add(n)
        elif not add:
            f.remove(key(n))
            live.discard(n)
        assert (f.find(key(n)) >= 0) == (n in live)
    slots = list(f.live())
    again = E.CuckooFilter.restore(f.buckets, [s for s, _ in slots], [f.keys[n] for _, n in slots])
    assert all((again.find(key(n)) >= 0) == (n in live) for n in range(61))


def test_index_over_batches(spark, scratch):
    """Insertions and deletions give the index of the rows that are left."""
    draw = random.Random(5)
    texts = [f"text {draw.randrange(40)}" + " " * draw.randrange(3) for _ in range(300)]
    rows = scratch.table(
        E.rows_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "rows"
    )
    shards = 4

    def state(index):
        return sorted((bytes(r.digest), r.rows, r.n_chars, r.id, r.row) for r in index.collect())

    first, second = rows.where("id < 200"), rows.where("id >= 200")
    index = scratch.table(E.build(first, shards), "built")
    index = scratch.table(E.insert(index, second, shards), "grown")
    assert state(index) == state(E.build(rows, shards))
    gone, left = rows.where("id % 3 > 0 or id < 90"), rows.where("id % 3 = 0 and id >= 90")
    index = scratch.table(E.delete(index, gone, left, shards), "shrunk")
    assert state(index) == state(E.build(left, shards))
    again = sorted((r.id, r.keep_id, r.group_size, r.kept) for r in E.resolve(left, index).collect())
    want = [r for r in range(90, 300) if r % 3 == 0]
    assert again == sorted(brute(want, [texts[k] for k in want]))
    assert state(E.delete(index, first, left, shards)) != []  # unknown digests are ignored
