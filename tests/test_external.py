import json

import pytest
from pyspark.sql import functions as F

from revlens.operators import external as EX
from revlens.plans import jobs
from revlens.sources.scratch import Scratch

HELD = "row_id long, label int, split string"
LOGITS = "model_id string, row_id long, logits array<double>"


def test_only_whole_models_have_results(spark):
    held = spark.createDataFrame(
        [(1, 1, "train"), (2, 1, "valid"), (3, 0, "valid"), (4, 1, "test"), (5, 0, "test")], HELD
    )
    good = [("good", k, [1.0 - k % 2, 1.0 * (k % 2)]) for k in (2, 3, 4, 5)]
    rows = good + [
        ("short", 2, [0.0, 1.0]),
        *[("null", k, [0.0, None]) for k in (2, 3, 4, 5)],
        *[("nan", k, [0.0, float("nan")]) for k in (2, 3, 4, 5)],
        *[("twice", k, [0.0, 1.0]) for k in (2, 2, 3, 4)],
        *[("wide", k, [0.0, 1.0, 2.0]) for k in (2, 3, 4, 5)],
    ]
    names = ("good", "short", "null", "nan", "twice", "wide", "absent")
    models = spark.createDataFrame([(n,) for n in names], "model_id string")
    runs = EX.external_runs(held, spark.createDataFrame(rows, LOGITS), models, Scratch(spark))
    assert {r.model_id: r.error for r in runs.failures.collect()} == {
        "short": "1 logits for 1 of 4 rows", "null": "0 logits for 0 of 4 rows",
        "nan": "0 logits for 0 of 4 rows", "twice": "4 logits for 3 of 4 rows",
        "wide": "0 logits for 0 of 4 rows", "absent": "0 logits for 0 of 4 rows",
    }
    (r,) = EX.flatten(runs.results).collect()
    assert (r.model_id, r.slug, r.train_rows, r.valid_rows, r.test_rows) == ("good", "good", 1, 2, 2)
    # rows 2 and 4 are 1 and get 0; rows 3 and 5 are 0 and get 1
    assert r.eval_accuracy == r.test_accuracy == r.test_f1 == r.eval_roc_auc == 0.0
    assert {p.model_id for p in runs.predictions.collect()} == {"good"}


def test_equal_logits_are_the_first_class(spark):
    held = spark.createDataFrame([(1, 0, "test")], HELD)
    logits = spark.createDataFrame([("m", 1, [0.5, 0.5])], LOGITS)
    runs = EX.external_runs(held, logits, logits.select("model_id"), Scratch(spark))
    (p,) = runs.predictions.collect()
    assert (p.prediction, p.score) == (0, 0.5)
    (r,) = runs.results.collect()
    assert r.eval_metrics is None and r.test_metrics.accuracy == 1.0


def test_job(spark, inputs, tmp_path):
    rows = inputs.prepared
    rows.write.parquet(f"{tmp_path}/prepared")
    logit = lambda sign: F.array(F.lit(0.0), sign * (F.col("label") * 2.0 - 1))
    both = rows.select(F.lit("org/right").alias("model_id"), "row_id", logit(1).alias("logits")).unionByName(
        rows.select(F.lit("org/wrong").alias("model_id"), "row_id", logit(-1).alias("logits"))
    )
    both.write.parquet(f"{tmp_path}/logits")
    cfg = jobs.ExternalConfig(
        f"{tmp_path}/prepared", f"{tmp_path}/logits", f"{tmp_path}/out",
        models=("org/right", "org/wrong", "org/none"), settings=(("max_length", "128"),),
    )
    ranked = jobs.external_run(spark, cfg).collect()
    assert [(r.model_id, r.test_f1, r.test_roc_auc) for r in ranked] == [("org/right", 1, 1), ("org/wrong", 0, 0)]
    log = json.loads(spark.read.text(f"{cfg.out}/run_log").first().value)
    assert [f["model_id"] for f in log["failures"]] == ["org/none"]
    right = log["results"][0]
    assert right["slug"] == "org__right" and right["max_length"] == "128"
    assert right["train_rows"] + right["valid_rows"] + right["test_rows"] == rows.count()
    assert right["eval_metrics"]["accuracy"] == 1.0
    saved = spark.read.parquet(f"{cfg.out}/test_predictions").where("slug = 'org__right'")
    assert saved.count() == right["test_rows"] and saved.where("label <> prediction").isEmpty()
    best = json.loads(spark.read.text(f"{cfg.out}/best_metadata").first().value)
    assert best["model_id"] == "org/right"
    none = jobs.ExternalConfig(cfg.prepared, cfg.logits, f"{tmp_path}/none", models=("org/none",))
    with pytest.raises(RuntimeError):
        jobs.external_run(spark, none)
    assert json.loads(spark.read.text(f"{none.out}/run_log").first().value)["results"] == []
