import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.operators import insights as I
from revlens.settings import STOPWORDS
from tests.test_text import py_tokens

GOLDEN = [
    ("enak", 173, 10), ("nyaman", 54, 10), ("ramah", 37, 9), ("terbaik", 18, 0),
    ("tidak", 23, 187), ("harga", 10, 28), ("buruk", 0, 19), ("antrean", 0, 19),
]


def test_golden_lift_and_order(spark):
    df = spark.createDataFrame(
        [(*row, 326, 371) for row in GOLDEN],
        "term string, positif_docs long, negatif_docs long, pos_total long, neg_total long",
    )
    rows = I.order_keywords(I.keyword_lift(df)).collect()
    assert [r.term for r in rows] == [
        "terbaik", "enak", "nyaman", "ramah", "harga", "tidak", "antrean", "buruk",
    ]
    lift = {r.term: r.lift for r in rows}
    assert lift["enak"] == pytest.approx(19.688036, abs=1e-6)
    assert lift["tidak"] == pytest.approx(0.139973, abs=1e-6)
    assert lift["terbaik"] == pytest.approx(55214724.926, rel=1e-9)
    assert {r.term for r in rows if r.dominant_label == "Negatif"} == {"harga", "tidak", "antrean", "buruk"}


def tokens(spark, rows):
    df = spark.createDataFrame(rows, "label int, text string")
    return df.select("label", X.tokens(F.col("text")).alias("tokens"))


def test_keyword_counts(spark):
    rows = [(1, "enak enak"), (1, "enak mahal"), (0, "mahal"), (0, ""), (0, "biasa")]
    got = I.keyword_counts(tokens(spark, rows), ["enak", "mahal", "pahit"]).collect()
    assert [(r.term, r.positif_docs, r.negatif_docs) for r in got] == [("enak", 2, 0), ("mahal", 1, 1)]
    assert got[1].positif_rate == 0.5 and got[1].negatif_rate == pytest.approx(1 / 3)


def test_keywords_of_one_class_or_none(spark):
    got = I.keyword_counts(tokens(spark, [(1, "enak")]), ["enak"]).first()
    assert (got.negatif_rate, got.dominant_label) == (0.0, "Positif")
    assert I.keyword_counts(tokens(spark, [(1, "lain")]), ["enak"]).count() == 0


REVIEWS = (
    [(1, "kopi susu gula aren enak sekali")] * 12
    + [(1, "gula batu enak"), (1, "susu kopi pahit"), (0, "antrean panjang lama")]
    + [(1, f"kata{i % 3} enak abc{chr(97 + i)} mantap") for i in range(20)]
    + [(0, "pelayanan lama antrean panjang")] * 9
)


def brute_cloud(rows, label, threshold, limit):
    words = [[w for w in py_tokens(t, 3) if w not in STOPWORDS] for y, t in rows if y == label]
    uni = Counter(w for ws in words for w in ws)
    pairs = Counter(p for ws in words for p in zip(ws, ws[1:]))
    total = sum(uni.values())

    def ll(k, n, p):
        return math.log(max(p, 1e-10)) * k + math.log(max(1 - p, 1e-10)) * (n - k)

    scores, counts = {}, Counter(uni)
    for (a, b), n in pairs.items():
        c1, c2 = uni[a], uni[b]
        if total <= c1 or total <= c2:
            scores[a, b] = 0.0
            continue
        p, p1, p2 = c2 / total, n / c1, (c2 - n) / (total - c1)
        scores[a, b] = -2 * (ll(n, c1, p) + ll(c2 - n, total - c1, p) - ll(n, c1, p1) - ll(c2 - n, total - c1, p2))
    for (a, b), n in pairs.items():
        if scores[a, b] > threshold:
            counts[a] -= n
            counts[b] -= n
            counts[f"{a} {b}"] = n
    best = sorted(((t, n) for t, n in counts.items() if n > 0), key=lambda x: (-x[1], x[0]))[:limit]
    return scores, best


def test_collocations_and_cloud(spark):
    docs = spark.createDataFrame(REVIEWS, "label int, text string")
    words = I.content_words(docs)
    for label in (0, 1):
        scores, best = brute_cloud(REVIEWS, label, 30.0, 5)
        got = {(r["first"], r["second"]): r.score for r in I.collocations(words).where(F.col("label") == label).collect()}
        assert got == pytest.approx(scores, abs=1e-9)
        cloud = I.word_cloud(words, limit=5).where(F.col("label") == label).orderBy(F.desc("n"), "term").collect()
        assert [(r.term, r.n) for r in cloud] == best
        assert cloud[0].relative == 1.0
    assert any(score > 30 for score in brute_cloud(REVIEWS, 1, 30.0, 5)[0].values())


def test_top_and_chart_terms(spark):
    weights = [("enak", 2.0), ("yang", 9.0), ("di jakarta", 1.0), ("ab", 5.0), ("buruk", -2.0), ("lama", -1.0)]
    df = spark.createDataFrame(weights, "term string, weight double")
    top = I.top_weighted_terms(df, limit=2)
    got = [(r.term, r.label_name) for r in top.collect()]
    assert got == [("enak", "Positif"), ("di jakarta", "Positif"), ("buruk", "Negatif"), ("lama", "Negatif")]
    chart = {r.term: (r.rank, r.signed_weight) for r in I.chart_terms(top, 1).collect()}
    assert chart == {"enak": (1, 2.0), "buruk": (1, -2.0)}


def test_history(spark):
    log = [{"epoch": 1.0, "step": 10, "loss": 0.5}, {"step": 20, "loss": 0.4}, {"epoch": 2.0, "eval_loss": 0.3},
           {"epoch": 3.0, "loss": None}]
    df = spark.createDataFrame([("m", json.dumps(log))], "model string, log_history string")
    rows = {(r.series, r.x, r.y) for r in I.history_series(df, "model").collect()}
    assert rows == {("train", 1.0, 0.5), ("train", 20.0, 0.4), ("eval", 2.0, 0.3)}


def test_run_log_round_trip(spark):
    done = spark.createDataFrame(
        [("a/b", "a__b", (0.9, 0.8, 0.7, 0.6, None))],
        "model_id string, slug string, test_metrics struct<accuracy:double,precision:double,recall:double,f1:double,roc_auc:double>",
    )
    failed = spark.createDataFrame([("c/d", "boom")], "model_id string, error string")
    log = I.run_log(done, failed)
    document = json.loads(log.first().value)
    assert document["failures"] == [{"model_id": "c/d", "error": "boom"}]
    row = I.flatten_runs(log).first()
    assert (row.model_id, row.test_f1, row.test_roc_auc) == ("a/b", 0.6, None)


def test_word_cloud_reads_its_tokens_back(spark, scratch, monkeypatch):
    """Texts are tokenised once, for the words and for the pairs."""
    docs = spark.createDataFrame([(1, "green leaf tea " * 3), (0, "slow queue"), (0, None)], "label int, text string")
    seen = []
    for name in ("word_frequencies", "collocations"):
        plain = getattr(I, name)
        monkeypatch.setattr(I, name, lambda words, *rest, plain=plain: (seen.append(words.inputFiles()), plain(words, *rest))[1])
    found = {(r.label, r.term): r.n for r in I.word_cloud(I.content_words(docs, ()), scratch=scratch).collect()}
    assert found[0, "slow"] == 1 and found[0, "queue"] == 1
    assert len(seen) == 2 and seen[0] and set(seen[0]) == set(seen[1])
