import json

import pytest
from pyspark.sql import functions as F

from revlens.operators.scoring import load_first_model, score_reviews
from revlens.plans import jobs
from revlens.settings import CompareOptions, TreeOptions, Word2VecOptions
from revlens.sources.scratch import Scratch, shared_folder


@pytest.fixture(scope="module")
def run(spark, inputs, tmp_path_factory):
    base = tmp_path_factory.mktemp("job")
    inputs.raw.write.json(str(base / "reviews.json"))
    out = str(base / "out")
    options = CompareOptions(
        folds=3,
        linear_iterations=5,
        models=("logistic_regression", "linear_svm", "random_forest"),
        word2vec=Word2VecOptions(vector_size=4, epochs=1, min_count=3),
        trees=TreeOptions(forest_trees=2, max_depth=3),
    )
    model = jobs.run_all(
        spark,
        jobs.RunConfig(
            jobs.PrepareConfig(str(base / "reviews.json"), out, "json", "csv"),
            jobs.CompareConfig(f"{out}/prepared", out, "csv", options),
        ),
    )
    return out, model


def test_summary_document(spark, run):
    document = json.loads(spark.read.text(f"{run[0]}/summary").first().value)
    assert document["input_file"] == "reviews.json"
    dropped = sum(v for k, v in document.items() if k.startswith("dropped"))
    assert document["original_rows"] == 200 == dropped + document["kept_rows"]
    assert document["labels"] == {"Negatif": 46, "Positif": 74}


def test_reports(spark, run, inputs):
    out = run[0]
    tables = jobs.dashboard(spark, out)
    results = tables["results"].collect()
    assert len(results) == 6 and {r.n for r in results} == {120}
    f1 = [r.f1 for r in results]
    assert f1 == sorted(f1, reverse=True)
    best = json.loads(spark.read.text(f"{out}/best_metadata").first().value)
    assert best["f1"] == pytest.approx(f1[0])
    assert tables["top_words"].count() == 120
    assert "kept_rows" in tables["summary"].first().value
    folds = spark.read.csv(f"{out}/fold_metrics", header=True)
    assert folds.count() == 18
    oof = spark.read.parquet(f"{out}/oof")
    assert oof.count() == 6 * 120
    one = oof.where("feature = 'tfidf' AND model = 'linear_svm'")
    texts = {r.row_id: r.text for r in one.collect()}
    assert texts == {r.row_id: r.text for r in inputs.prepared.collect()}
    reports = spark.read.json(f"{out}/reports")
    assert reports.count() == 6 and {"Negatif", "macro avg", "accuracy"} <= set(reports.columns)
    assert "score_kind" in oof.columns
    cells = spark.read.csv(f"{out}/best_confusion", header=True, inferSchema=True)
    assert cells.agg(F.sum("n")).first()[0] == 120


def test_saved_model_scores(spark, run, inputs):
    out, model = run
    back = load_first_model(spark, [f"{out}/best_model"])
    df = inputs.prepared.select("row_id", "text")
    a, b = ({r.row_id: r.p_positif for r in score_reviews(df, m).collect()} for m in (model, back))
    assert a == pytest.approx(b)


def test_dashboard_before_any_run(spark, tmp_path):
    tables = jobs.dashboard(spark, str(tmp_path / "none"))
    assert set(tables) == {"results", "top_words", "keyword_counts", "summary"}
    assert all(t.count() == 0 for t in tables.values())


def test_skip_flags(spark, tmp_path):
    cfg = jobs.RunConfig(
        jobs.PrepareConfig("/nowhere", str(tmp_path)),
        jobs.CompareConfig("/nowhere", str(tmp_path)),
        skip_prepare=True,
        skip_compare=True,
    )
    assert jobs.run_all(spark, cfg) is None


def test_scratch_is_in_the_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert Scratch(spark).root.startswith(shared_folder(spark))
