import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from revlens.llm import bpe, kit, packing
from tests_llm_prose import sentences

PARTS = [" ", "  ", "\n", "\t", "a", "B", "'s", "'re", "1", "٣", "é", "日", "\xa0", "\x1c", "\x85", " ",
         "<|endoftext|>", "!", "?", ".", " the", "ing", "ʰ", "²", "\0", "﻿", "\x0b", " le.", " né!", "😀"]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def random_texts(count):
    r = random.Random(7)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(count)]


def test_both_encoders_equal_the_library(vocabulary, library, odd_texts):
    texts = random_texts(3000) + [t or "" for t in odd_texts] + [sentences(k) for k in range(5)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for own in (bpe.Tokenizer(vocabulary), packing.Library(vocabulary)):
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == want
    own = bpe.Tokenizer(vocabulary)
    for text, ids in zip(texts, want):
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False) == text


def test_memory_is_bounded():
    memory = bpe.TwoGenerations(10)
    for k in range(100):
        keys = [str(k), str(k // 2), "x" * 100]
        assert memory.get_all(keys, lambda new: [n + "!" for n in new]) == [n + "!" for n in keys]
    assert len(memory.new) <= 12 and len(memory.old) <= 12


def test_pieces_are_bounded(vocabulary, library):
    """What a worker remembers goes by characters, whatever the words, and one
    long piece is not kept for good."""
    own = packing.Library(vocabulary)
    own.pieces.most = 2000
    for k in range(40):
        text = f"word{k} " + "".join(map(chr, (97 + (k * j) % 26 for j in range(300)))) + " the end" * 3
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == want
        assert own.pieces.held <= 2000 + len(text)
        assert sum(map(len, own.pieces.number)) <= own.pieces.held + 1
        assert len(own.pieces.flat) == own.pieces.sizes.sum()


def test_cut_gives_every_token_its_place():
    """Pieces of stretches, as arrays: each window's part of a queue, token by token."""
    r = random.Random(8)
    for _ in range(20):
        totals = [r.choice([0, 1, 3, 50, 700]) for _ in range(r.randint(1, 6))] + [5]
        mix = packing.Mixture(totals, packing.Options(length=16, run_windows=3))
        laid = {}
        for queue, total in enumerate(totals):
            at = 0
            while at < total:
                size = min(total - at, r.choice([1, 2, 30, 200]))
                place, tokens, window, offset = mix.cut(queue, at, at + size)
                assert place.tolist() == [at, *(at + np.cumsum(tokens))[:-1].tolist()]
                assert (tokens > 0).all() and tokens.sum() == size
                for w, o, n in zip(window.tolist(), offset.tolist(), tokens.tolist()):
                    for k in range(n):
                        assert laid.setdefault((w, o + k), (queue, at)) == (queue, at)
                        at += 1
        assert sorted(laid) == [divmod(k, 16) for k in range(sum(totals))]
        assert mix.cut(0, 0, 0).shape == (4, 0)


def test_batches_are_small(make_docs):
    """Batches for Python go by bytes; the setting is as before afterwards."""
    docs = make_docs(["x" * 1000] * 400).coalesce(1)
    spark = docs.sparkSession
    before = spark.conf.get(kit.BATCH_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    with kit.small_batches(spark, 50_000):
        got = [r.n for r in docs.select("text").mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) == 400 and max(got) < 100
    assert spark.conf.get(kit.BATCH_BYTES) == before


def test_encode_decode_of_odd_rows(make_docs, odd_texts, vocabulary):
    docs = make_docs(odd_texts, ids=[None, 1, 1, *range(3, len(odd_texts))])
    rows = bpe.encode_decode(docs, vocabulary).collect()
    assert sorted(r.decoded for r in rows) == sorted(t or "" for t in odd_texts)
    assert bpe.encode_decode(docs.where("false"), vocabulary).count() == 0


@pytest.mark.parametrize(
    "options", [packing.Options(length=64, run_windows=4), packing.Options(fan_out=2, length=128)]
)
def test_packing(make_docs, odd_texts, vocabulary, library, options):
    texts = odd_texts + [sentences(k, 10 + 30 * (k % 5)) for k in range(60)]
    sources = [None if k % 11 == 0 else "big" if k % 3 == 0 else f"s{k % 4}" for k in range(len(texts))]
    docs = make_docs(texts, sources=sources).repartition(3, "doc_id")
    rows = packing.pack(docs, vocabulary, options).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    for k, want in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.length) == (at, len(want), len(r.ids))
            assert list(r.ids) == want[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    full = max(filled)
    assert sorted(filled) == list(range(full + 1))
    assert all(filled[k] == options.length for k in range(full))
    # every window holds each queue's share, to within a few tokens
    total = sum(map(len, ids.values()))
    big = sum(len(ids[k]) for k, s in enumerate(sources) if s == "big") / total
    for k in range(full):
        have = sum(r.length for r in rows if r.sequence_id == k and r.source == "big")
        assert abs(have - big * options.length) <= 4


def test_every_source_keeps_its_share(make_docs, vocabulary):
    """A thousand sources, one of them with a third of the tokens."""
    r = random.Random(2)
    sources = [f"s{k % 1000}" if k % 3 else "big" for k in range(3000)]
    texts = [" ".join(r.choices(["a", "the", "word", "of"], k=60)) for _ in sources]
    docs = make_docs(texts, sources=sources)
    options = packing.Options(run_windows=8)
    rows = packing.pack(docs, vocabulary, options, with_ids=False).collect()
    totals, have = {}, {}
    for p in rows:
        totals[p.source] = totals.get(p.source, 0) + p.length
        have[p.sequence_id, p.source] = have.get((p.sequence_id, p.source), 0) + p.length
    whole = sum(totals.values())
    full = max(p.sequence_id for p in rows)
    assert full > 80 and len(totals) > 600
    for window in range(full):
        for source, n in totals.items():
            off = have.get((window, source), 0) - n / whole * options.length
            assert abs(off) <= 8, (window, source, off)
    # over all windows so far, too
    for source, n in totals.items():
        so_far = 0.0
        for window in range(full):
            so_far += have.get((window, source), 0) - n / whole * options.length
            assert abs(so_far) <= 16, (window, source, so_far)


@pytest.mark.parametrize("fan_out", [2, 256])
def test_target_shares(make_docs, vocabulary, fan_out):
    r = random.Random(3)
    sources = [r.choice(["a", "b", "c", "d", "e"]) for _ in range(600)]
    texts = [" ".join(r.choices(["a", "the", "word", "of"], k=50)) for _ in sources]
    docs = make_docs(texts, sources=sources)
    options = packing.Options(length=256, run_windows=8, fan_out=fan_out)
    targets = {"a": 0.5, "b": 0.3} | ({"none": 0.1} if fan_out > 2 else {})
    rows = packing.pack(docs, vocabulary, options, with_ids=False, targets=targets).collect()
    totals, have, ends = {}, {}, {}
    for p in rows:
        totals[p.source] = totals.get(p.source, 0) + p.length
        have[p.sequence_id, p.source] = have.get((p.sequence_id, p.source), 0) + p.length
        ends[p.source] = max(ends.get(p.source, 0), p.sequence_id)
    assert totals["a"] == sum(51 for s in sources if s == "a")
    full = max(p.sequence_id for p in rows)
    filled = [sum(have.get((k, s), 0) for s in totals) for k in range(full + 1)]
    assert filled[:full] == [256] * full and 0 < filled[full] <= 256
    rest = sum(totals[s] for s in "cde")
    want = {"a": 0.5, "b": 0.3} | {s: 0.2 * totals[s] / rest for s in "cde"}
    assert ends["a"] < ends["b"] < full
    for k in range(ends["a"]):
        for s, share in want.items():
            assert abs(have.get((k, s), 0) - 256 * share) <= 8, (k, s)
    for k in range(ends["a"] + 1, ends["b"]):
        for s in "bcde":
            assert abs(have.get((k, s), 0) - 256 * want[s] / (1 - want["a"])) <= 10, (k, s)


def test_target_shares_of_all_sources(make_docs, vocabulary):
    docs = make_docs(["a b c d"] * 90, sources=["a", "b", "a"] * 30)
    options = packing.Options(length=16, run_windows=4)
    rows = packing.pack(docs, vocabulary, options, targets={"a": 0.5, "b": 0.5}).collect()
    halves = [sum(p.length for p in rows if p.sequence_id == 3 and p.source == s) for s in "ab"]
    assert sum(halves) == 16 and abs(halves[0] - 8) <= 2
    assert sum(p.length for p in rows) == sum({p.doc_id: p.doc_tokens for p in rows}.values())
    for wrong in ({"a": 0.0}, {"a": 1.2}, {"a": 1.0}):
        with pytest.raises(ValueError):
            packing.pack(docs, vocabulary, options, targets=wrong)


def test_weighted_plan_takes_every_token_once():
    r = random.Random(6)
    for _ in range(60):
        totals = [r.choice([0, 1, 3, 50, 1000, 9000]) for _ in range(r.randint(1, 9))] + [5]
        weights = [r.choice([1, 7, 1000, 10**8]) for _ in totals]
        mix = packing.Mixture(totals, packing.Options(length=32, run_windows=8), weights=weights)
        for run in range(mix.runs):
            low, high = mix.starts(run), mix.starts(run + 1)
            assert all(a <= b for a, b in zip(low, high))
            edges, _ = mix.plan(run)
            assert edges[0].tolist() == low and edges[-1].tolist() == high
            takes = np.diff(edges, axis=0)
            assert (takes >= 0).all() and (takes[:-1].sum(1) == 32).all()
        assert mix.starts(mix.runs) == totals
        for queue, total in enumerate(totals):
            got = [n for _, n, _, _ in mix.pieces(queue, 0, total)] if total else []
            assert sum(got) == total


def test_packing_of_no_rows(make_docs, vocabulary):
    out = packing.pack(make_docs(["a"]).where("false"), vocabulary)
    assert out.count() == 0 and "sequence_id" in out.columns


def test_plan_takes_every_token_once():
    r = random.Random(5)
    for _ in range(30):
        totals = [r.choice([0, 1, 3, 50, 1000, 20_000]) for _ in range(r.randint(1, 9))] + [5]
        mix = packing.Mixture(totals, packing.Options(length=32, run_windows=8))
        for run in range(mix.runs):
            low, high = mix.starts(run), mix.starts(run + 1)
            assert all(a <= b for a, b in zip(low, high))
            edges, offsets = mix.plan(run)
            assert edges[0].tolist() == low and edges[-1].tolist() == high
            takes = np.diff(edges, axis=0)
            assert (takes >= 0).all() and (takes[:-1].sum(1) == 32).all()
        assert mix.starts(mix.runs) == totals
