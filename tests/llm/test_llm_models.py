import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens.llm import langid, topk, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = langid.fold_is("doc_id", 3, 1)
    model = langid.fit(docs.where(~held))
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    row = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and 0 <= row[1] <= row[2] <= 1


def test_language_of_odd_rows(make_docs, odd_texts):
    docs = make_docs(odd_texts, ids=[None, 1, 1, *range(3, len(odd_texts))])
    model = langid.fit(docs.where("doc_id > 4"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got[None] == got[1] == got[4] == "und" and got[7] == "en"
    assert langid.identify(docs.where("false"), model).count() == 0
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def exact_grams(text, orders):
    """The n-grams of a text as strings, one blank for a run of other signs."""
    signs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    clean = re.sub(" +", " ", f" {signs} ")
    return [clean[k : k + n] for n in orders for k in range(len(clean) - n + 1)]


def test_predictions_equal_those_of_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    held = langid.fold_is("doc_id", 3, 1)
    options = langid.Options(slots_per_key=256, min_share=1e-4)
    model = langid.fit(docs.where(~held), options)
    rows = docs.withColumn("held", held).collect()
    counts = {}
    for r in rows:
        if not r.held and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(exact_grams(r.text or "", options.orders))
    sets = {
        lang: {g for g, n in c.items() if n / sum(c.values()) >= options.min_share}
        for lang, c in counts.items()
    }
    assert model.languages == sorted(sets)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    firm = 0
    for r in rows:
        grams = exact_grams(r.text or "", options.orders)
        seen = {lang: sum(g in s for g in grams) for lang, s in sets.items()}
        if not any(c.isalpha() for c in r.text or ""):
            continue
        best = max(sorted(seen), key=seen.get)
        assert abs(got[r.doc_id].score - seen[best] / max(sum(seen.values()), 1)) < 0.005
        ranked = sorted(seen.values())
        if ranked[-1] - ranked[-2] > 0.01 * len(grams):
            firm += 1
            assert got[r.doc_id].lang_pred == best
    assert firm > 300


def test_filter_returns_all_languages_and_corrects():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, 4000, dtype=np.uint64)
    masks = r.integers(1, 2**20, (4000, 1), dtype=np.uint64)
    model = langid.Filter([f"l{k:02}" for k in range(20)], keys, masks, langid.Options(slots_per_key=2))
    found = model.languages_of(keys)[0].astype(np.uint64)
    assert (found & masks[:, 0] == masks[:, 0]).all()
    strange = model.languages_of(r.integers(2**63, 2**64, 20000, dtype=np.uint64))[0]
    for k in range(20):
        rate = ((strange >> np.uint32(k)) & np.uint32(1)).mean()
        assert abs(rate - model.false_rate[k]) < 0.03


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(1)
    word = lambda low, high: "".join(r.choice("abc") for _ in range(r.randint(low, high)))
    for _ in range(2000):
        words = {word(3, 9): r.random() for _ in range(4)}
        stems = {word(3, 6): r.random() for _ in range(3)}
        w = word(1, 11)
        hits = [
            (d, -v)
            for t, v in words.items()
            if t[0] == w[0] and (d := distance(w, t)) <= toxicity.allowed(len(t))
        ]
        for t, v in stems.items():
            if t[0] != w[0]:
                continue
            near = min((distance(w[:k], t) for k in range(len(w))), default=9)
            if near <= toxicity.allowed(len(t)):
                hits.append((near, -v))
        got = toxicity.Lexicon(words | {t + "*": v for t, v in stems.items()}).find(w)
        assert (got and (got[1], -got[0])) == (min(hits) if hits else None), (w, words, stems)


def test_nearest_equals_edit_distance_of_any_first_letter():
    r = random.Random(2)
    word = lambda low, high: "".join(r.choice("abc") for _ in range(r.randint(low, high)))
    for _ in range(3000):
        words = {word(3, 9): r.random() for _ in range(4)}
        stems = {word(3, 8): r.random() for _ in range(3)}
        w = word(1, 11)
        hits = [(d, -v) for t, v in words.items() if (d := distance(w, t)) <= toxicity.allowed(len(t))]
        for t, v in stems.items():
            near = min((distance(w[:k], t) for k in range(len(w))), default=9)
            if near <= toxicity.allowed(len(t)):
                hits.append((near, -v))
        got = toxicity.Lexicon(words | {t + "*": v for t, v in stems.items()}).nearest(w)
        assert (got and (got[1], -got[0])) == (min(hits) if hits else None), (w, words, stems)


def test_misspelled_first_letters_are_hits():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 4.0, "moron*": 3.0}), toxicity.Options())
    for w in ("idiot", "fdiot", "diot", "xidiot", "1diot", "morons", "norons", "orons", "xmorons"):
        assert scorer.features(f"what an {w} it was")[-1] == 0.2, w


def test_words_inside_tokens():
    words = toxicity.words_of
    assert words('"idiot!"') == ["idiot"] and words("don't") == ["don't", "don"]
    assert words("you/idiot_now") == ["you/idiot_now", "you", "idiot", "now"]
    assert words("42") == words("a") == []
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 4.0, "moron*": 3.0, "scum": 2.0}), toxicity.Options())
    for w in ("you/idiot", "the_moronic_one", "moron" + "x" * 5000, "id1ot", "sxum", "cum", "scums"):
        assert scorer.features(f"what an {w} it was")[-1] == 0.2, w
    for w in ("idiot" + "x" * 5000, "sum/total", "the_one", "sc"):
        assert (scorer.features(f"what an {w} it was")[-1] > 0) == (w == "sum/total"), w
    both = scorer.features("you/idiot_and_scum")
    assert both[0] == pytest.approx(np.log1p(6.0))


def brute_hits(token, terms):
    """(weight, edits) of a token by plain edit distances to all terms."""

    def nearest(w):
        found = []
        for t, v in terms.items():
            body, stem = t.rstrip("*"), t.endswith("*")
            ends = [w[:k] for k in range(len(w))] if stem else [w]
            d = min((distance(e, body) for e in ends if abs(len(e) - len(body)) <= 1), default=9)
            if d <= (1 if len(body) >= 4 else 0):
                found.append((d, -v))
        return (-min(found)[1], min(found)[0]) if found else None

    whole = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", token)
    runs = re.findall(r"[^\W\d_]+", whole)
    found = nearest(whole) if len(whole) >= 3 else None
    if found and not found[1] or len(runs) <= 1:
        return [found] if found else []
    inner = [h for w in runs if len(w) >= 3 and (h := nearest(w))]
    return inner or ([found] if found else [])


def test_scores_equal_those_by_plain_edit_distance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 = 0"))
    terms, todo = {}, [("", model.lexicon.root)]
    while todo:
        head, node = todo.pop()
        terms |= {head: node.word} if node.word is not None else {}
        terms |= {head + "*": node.stem} if node.stem is not None else {}
        todo += [(head + c, child) for c, child in node.children.items()]
    assert len(terms) > 10
    some = docs.join(labels.where("toxic = 1").limit(25).select("doc_id"), "doc_id")
    some = some.unionByName(docs.limit(25)).select("doc_id", "text")
    known, size = {}, model.options.window
    texts = [(r.doc_id, (r.text or "")[:3000]) for r in some.collect()]
    cut = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(cut, model).collect()}
    for doc_id, text in texts:
        tokens = text.lower().split()
        sums, hits = [0.0] * 4, 0
        for at, token in enumerate(tokens):
            if token not in known:
                known[token] = brute_hits(token, terms)
            hits += bool(known[token])
            near = tokens[max(0, at - size) : at + size + 1]
            for weight, edits in known[token]:
                if toxicity.quoted(tokens, at, size):
                    sums[2] += weight
                    continue
                sums[1 if edits else 0] += weight
                sums[3] += weight * any(t in toxicity.ADDRESSED for t in near)
        x = [1.0, *np.log1p(sums), hits / max(len(tokens), 1)]
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-np.dot(model.weights, x))), abs=1e-9)


def test_quotations():
    tokens = 'he said "you idiot!" and then you idiot left'.split()
    assert toxicity.quoted(tokens, 3, 8) and not toxicity.quoted(tokens, 7, 8)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = langid.fold_is("doc_id", 5, 0)
    model = toxicity.fit(docs, labels.where(~held))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(held).collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = np.sort([r.score for r in rows if r.toxic == 0])
    auc = np.mean([np.searchsorted(clean, s) for s in toxic]) / len(clean)
    assert auc > 0.93
    assert np.mean(np.array(toxic) >= 0.5) > 0.8 and np.mean(clean >= 0.5) < 0.02


def test_toxicity_of_odd_rows(make_docs, odd_texts):
    docs = make_docs(odd_texts, ids=[None, 1, 1, *range(3, len(odd_texts))])
    labels = docs.select("doc_id", F.lit(0).alias("toxic")).where("false")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert [r.score for r in rows] == [0.5] * len(odd_texts)


@pytest.mark.parametrize("sizes", [{}, dict(head=3, shard_rows=7, query_rows=2, step_rows=2)])
def test_top_k_equals_brute_force(spark, sizes):
    r = np.random.default_rng(2)
    x = [list(map(float, v)) for v in r.integers(-3, 4, (60, 5)) / 4]
    x += [x[0]] * 10 + [None, [None, 1.0], [float("nan")] * 5, [float("inf"), 0.0], [], [0.5]]
    ids = list(range(len(x)))
    ids[11] = None
    ids[12] = 10
    rows = [(i, v, "e", 1) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, norm2 int")
    ints = {}
    for k, (i, v) in enumerate(zip(ids, x)):
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            ints[k] = (i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] + [0] * (5 - len(v)))
    want = []
    for i, q in ints.values():
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ints.values() if j != i)
            want.append([(i, k + 1, j, -s) for k, (s, j) in enumerate(found[:5])])
    out = topk.top_k(df, F.col("vec_id") % 10 == 0, options=topk.Options(**sizes))
    got = sorted(tuple(r) for r in out.collect())
    once = sorted({row for rows in want for row in rows})
    assert sorted({row for row in got if row[0] != 10}) == [row for row in once if row[0] != 10]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_sends_only_what_can_reach_a_query(spark):
    """Lengths fall by shard, so most pairs of a block and a shard never meet."""
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 8))
    x *= (100 * 0.998 ** np.arange(4000) / np.linalg.norm(x, axis=1))[:, None]
    rows = [(k, list(map(float, v))) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    o = topk.Options(head=256, shard_rows=200, query_rows=20)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, options=o).collect()
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 4000, 10):
        scores = ints @ ints[q]
        order = [j for j in np.lexsort((np.arange(4000), -scores)) if j != q][:5]
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert mine == [(k + 1, j, scores[j]) for k, j in enumerate(order)]

    tops = 100 * 256 * 0.998 ** np.arange(0, 4000, 200)
    floors = np.array([np.sort(ints[:256] @ ints[q])[-6] for q in range(0, 4000, 10)])
    norm2 = (ints[::10].astype(float) ** 2).sum(1)
    last = topk.last_shards(pd.DataFrame({"norm2": norm2}), floors, tops)
    for q in range(400):
        may = np.sqrt(norm2[q]) * tops >= floors[q]
        assert not may[last[q] + 1 :].any()
    queries = [(q, int(last[q]), b) for b, q in enumerate(np.argsort(-last, kind="stable"))]
    queries = spark.createDataFrame([(int(q), n, b // 20) for q, n, b in queries], "vec_id long, last int, block int")
    vectors = spark.createDataFrame(
        [(k, [1], 1.0, k // 200) for k in range(4000)], "vec_id long, x array<bigint>, norm2 double, shard int"
    )
    left, right = topk.meetings(queries, vectors, 20)
    pairs = right.select("block", "shard").distinct().count()
    assert pairs < 20 * 20 / 2 and right.count() == 200 * pairs
    asked = left.select("block", "shard").distinct()
    assert asked.join(right.select("block", "shard").distinct(), ["block", "shard"], "left_anti").count() == 0


def test_top_k_of_vectors_of_no_length(spark):
    rows = [(k, [0.0, 0.0]) for k in range(8)] + [(8, [-0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 4 == 0, options=topk.Options(shard_rows=2, query_rows=1, head=2))
    found = {}
    for g in got.collect():
        found.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert sorted(found[0]) == [(k + 1, j, 0) for k, j in enumerate([1, 2, 3, 4, 5])]
    assert sorted(found[8]) == [(k + 1, k, 0) for k in range(5)]
