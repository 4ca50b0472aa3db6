import json
import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import evaluate as E

# tn, fp, fn, tp; then accuracy, precision, recall, f1 as published.
GOLDEN = {
    "tfidf+linear_svm": ((364, 7, 11, 315), (0.9742, 0.9783, 0.9663, 0.9722)),
    "word2vec+extra_trees": ((366, 5, 16, 310), (0.9699, 0.9841, 0.9509, 0.9672)),
    "word2vec+linear_svm": ((362, 9, 15, 311), (0.9656, 0.9719, 0.9540, 0.9628)),
    "word2vec+logistic_regression": ((365, 6, 18, 308), (0.9656, 0.9809, 0.9448, 0.9625)),
    "tfidf+logistic_regression": ((366, 5, 19, 307), (0.9656, 0.9840, 0.9417, 0.9624)),
    "word2vec+gradient_boosting": ((361, 10, 15, 311), (0.9641, 0.9688, 0.9540, 0.9614)),
    "word2vec+random_forest": ((365, 6, 20, 306), (0.9627, 0.9808, 0.9387, 0.9592)),
    "tfidf+extra_trees": ((355, 16, 24, 302), (0.9426, 0.9497, 0.9264, 0.9379)),
    "tfidf+random_forest": ((350, 21, 20, 306), (0.9412, 0.9358, 0.9387, 0.9372)),
    "tfidf+gradient_boosting": ((345, 26, 31, 295), (0.9182, 0.9190, 0.9049, 0.9119)),
}
SCHEMA = "model string, fold int, label int, prediction int, score double"


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for name, ((tn, fp, fn, tp), _) in GOLDEN.items():
        cells = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
        rows += [(name, 1, y, p, float(p)) for y, p, n in cells for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_golden_metrics(golden, scratch):
    rows = {r.model: r for r in E.metrics(golden, "model", scratch=scratch).collect()}
    for name, (cells, published) in GOLDEN.items():
        r = rows[name]
        assert r.n == 697
        assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx(published, abs=5e-5)
        tn, fp, fn, tp = cells
        # With the prediction as the score the AUC is the mean of both recalls.
        assert r.roc_auc == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_golden_ranking(golden, scratch):
    results = E.metrics(golden, "model", scratch=scratch)
    ranked = [r.model for r in E.rank_candidates(results, tie_break="model").collect()]
    assert ranked == list(GOLDEN)
    assert E.best_candidate(results, tie_break="model").first().model == "tfidf+linear_svm"


def test_golden_report(golden):
    one = golden.where("model = 'tfidf+linear_svm'")
    document = json.loads(E.report_documents(E.class_report(one)).first().report)
    assert document["Negatif"] == pytest.approx(
        {"precision": 0.9706666666666667, "recall": 0.9811320754716981,
         "f1-score": 0.9758713136729222, "support": 371.0}
    )
    assert document["accuracy"] == pytest.approx(0.9741750358680057)
    assert document["macro avg"]["f1-score"] == pytest.approx(0.9740467679475722)
    assert document["weighted avg"]["precision"] == pytest.approx(0.9742186180941094)


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def random_scores(spark):
    rng = random.Random(11)
    rows = []
    for model, digits in (("ties", 1), ("fine", 9), ("hot", 2)):
        for i in range(600):
            y = rng.randrange(2)
            s = round(min(max(rng.gauss(0.4 + 0.2 * y, 0.3), -0.5), 1.5), digits)
            if model == "hot" and i % 3 == 0:
                s = 0.5
            rows.append((model, i % 4 + 1, y, int(s > 0.5), s))
    return rows


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_auc_by_ranges(spark, random_scores, scratch, ranges):
    df = spark.createDataFrame(random_scores, SCHEMA).repartition(5)
    scores = scratch.table(E.score_table(df, "model"), "s")
    got = {r.model: r.roc_auc for r in E.metrics_of(scores, "model", ranges=ranges).collect()}
    for model in ("ties", "fine", "hot"):
        rows = [(y, s) for m, _, y, _, s in random_scores if m == model]
        assert got[model] == pytest.approx(brute_auc(rows), abs=1e-12)


def test_fold_and_pooled(spark, random_scores, scratch):
    df = spark.createDataFrame(random_scores, SCHEMA)
    rows = E.fold_and_pooled_metrics(df, "model", scratch=scratch).collect()
    assert len(rows) == 15
    for r in rows:
        part = [(y, s) for m, f, y, _, s in random_scores if m == r.model and r.fold in (None, f)]
        assert r.n == len(part)
        assert r.roc_auc == pytest.approx(brute_auc(part), abs=1e-12)


def test_undefined_metrics(spark, scratch):
    rows = [
        ("one class", 1, 1, 1, 0.3), ("one class", 1, 1, 0, 0.2),
        ("gap", 1, 1, 1, None), ("gap", 1, 0, 1, 0.2),
        ("nan", 1, 1, 1, float("nan")), ("nan", 1, 0, 1, 0.2),
        ("no scores", 1, 1, 1, None), ("no scores", 1, 0, 0, None),
        ("never positive", 1, 1, 0, 0.9), ("never positive", 1, 0, 0, 0.1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.model: r for r in E.metrics(df, "model", scratch=scratch).collect()}
    assert [m for m, r in got.items() if r.roc_auc is not None] == ["never positive"]
    assert got["never positive"].precision == 0.0 and got["never positive"].f1 == 0.0
    curves = E.roc_points(df, "model", scratch=scratch).collect()
    assert {r.model for r in curves} == {"never positive"}
    cells = E.confusion_matrix(df.where("model = 'gap'"), "model").collect()
    assert {(r.label, r.prediction): r.n for r in cells} == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 1}


def brute_curve(rows, drop):
    p, m = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    points = []
    for s in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, v in rows if y and v >= s)
        fp = sum(1 for y, v in rows if not y and v >= s)
        points.append((s, fp, tp))
    if drop:
        inner = [
            b for a, b, c in zip(points, points[1:], points[2:])
            if (c[1] - b[1], c[2] - b[2]) != (b[1] - a[1], b[2] - a[2])
        ]
        points = [points[0], *inner, points[-1]]
    return {(s, fp / m, tp / p) for s, fp, tp in points} | {(float("inf"), 0.0, 0.0)}


@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("ranges", [3, 64])
def test_roc_curve(spark, random_scores, scratch, drop, ranges):
    df = spark.createDataFrame(random_scores, SCHEMA)
    got = E.roc_points(df, "model", scratch=scratch, drop_collinear=drop, ranges=ranges).collect()
    for model in ("ties", "fine", "hot"):
        rows = [(y, s) for m, _, y, _, s in random_scores if m == model]
        assert {(r.threshold, r.fpr, r.tpr) for r in got if r.model == model} == brute_curve(rows, drop)


def test_ranking_ties_and_missing(spark):
    df = spark.createDataFrame(
        [(2, 0.9, 0.8, 0.7), (1, 0.9, 0.8, 0.7), (3, 0.9, None, 0.99), (4, None, 1.0, 1.0), (5, 0.95, None, 0.1)],
        "candidate_id int, test_f1 double, test_roc_auc double, test_accuracy double",
    )
    assert [r.candidate_id for r in E.rank_candidates(df, "test_").collect()] == [5, 1, 2, 3, 4]


def test_confusion_counts(golden):
    total = E.confusion_matrix(golden, "model").agg(F.sum("n")).first()[0]
    assert total == 6970
