"""Jobs: prepare a raw table, compare candidates, both in a row, and the tables
that a dashboard shows. Everything passes through tables in ``out``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from revlens.functions import text as X
from revlens.operators import crossval as CV
from revlens.operators import evaluate as E
from revlens.operators import external as EX
from revlens.operators import insights as I
from revlens.operators import prepare as P
from revlens.operators import split as S
from revlens.operators.scoring import save_model
from revlens.settings import CompareOptions
from revlens.sources import readers, writers
from revlens.sources.scratch import Scratch, path_exists

RESULT_COLUMNS = (
    "candidate_id", "feature", "model", "folds", "n", "accuracy", "precision", "recall", "f1", "roc_auc",
)


@dataclass(frozen=True)
class PrepareConfig:
    input: str
    out: str
    input_format: str = "parquet"
    output_format: str = "parquet"
    dedupe: bool = True
    # For a small input of few file splits: deal its rows out to so many tasks.
    input_partitions: int | None = None


@dataclass(frozen=True)
class CompareConfig:
    prepared: str
    out: str
    prepared_format: str = "parquet"
    options: CompareOptions = field(default_factory=CompareOptions)
    input_partitions: int | None = None
    # Keep finished folds in ``out/progress`` and go on from there.
    resume: bool = False


def prepare(spark: SparkSession, cfg: PrepareConfig) -> DataFrame:
    """Write ``out/prepared`` and ``out/summary``; return the summary row."""
    raw = readers.spread(
        readers.read_raw(spark, cfg.input, cfg.input_format), cfg.input_partitions, "row_id"
    )
    scratch = Scratch(spark)
    # The texts are cleaned once, for the rows and for the counts.
    tagged = scratch.table(P.tag_rows(raw), "tagged")
    rows = P.usable_rows(tagged)
    rows = P.deduplicated(rows, scratch) if cfg.dedupe else rows.drop("digest")
    writers.write_table(rows, f"{cfg.out}/prepared", cfg.output_format)
    summary = scratch.table(P.summarize(tagged, cfg.dedupe), "summary")
    document = writers.summary_document(
        summary, cfg.input.rstrip("/").rsplit("/", 1)[-1], f"{cfg.out}/prepared"
    )
    writers.write_json(document, f"{cfg.out}/summary")
    return summary


def pooled_results(metrics: DataFrame, folds: int) -> DataFrame:
    return (
        metrics.where(F.col("fold").isNull())
        .withColumn("folds", F.lit(folds))
        .select(*RESULT_COLUMNS)
    )


def fold_results(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("fold").isNotNull()).withColumnRenamed("n", "n_valid")


def compare(spark: SparkSession, cfg: CompareConfig) -> PipelineModel:
    """Cross-validate all candidates, write every report, refit and save the
    best one. Returns it."""
    o = cfg.options
    scratch = Scratch(spark)
    source = readers.spread(
        readers.read_prepared(spark, cfg.prepared, cfg.prepared_format),
        cfg.input_partitions,
        "row_id",
    )
    # Cleaned once; a few columns of it are read many times.
    rows = scratch.table(
        readers.labelled(source).select("row_id", "text", "label", "label_name"), "labelled"
    )
    found = CV.compare(rows, o, scratch, f"{cfg.out}/progress" if cfg.resume else None)
    keys = ("candidate_id", "feature", "model")
    oof = found.predictions
    texts = rows.select("row_id", "text")
    writers.write_table(
        writers.prediction_frame(oof.join(texts, "row_id"), "feature", "model", "fold", "row_id"),
        f"{cfg.out}/oof",
        partition_by=("feature", "model"),
    )
    # Candidates x (folds + 1) rows.
    metrics = scratch.table(E.fold_and_pooled_metrics(oof, *keys, scratch=scratch), "metrics")
    ranked = E.rank_candidates(pooled_results(metrics, o.folds))
    writers.write_report(ranked, f"{cfg.out}/results")
    writers.write_report(fold_results(metrics).orderBy(*keys, "fold"), f"{cfg.out}/fold_metrics")
    writers.write_report(found.status, f"{cfg.out}/status")
    reports = E.report_documents(E.class_report(oof, "feature", "model"), "feature", "model")
    writers.write_table(reports, f"{cfg.out}/reports", "text", ("feature", "model"))

    best = ranked.limit(1)
    winner = best.first()
    model = CV.fit_final(rows, winner.feature, winner.model, o)
    save_model(model, f"{cfg.out}/best_model")
    writers.write_json(
        best.select(writers.document(*best.columns).alias("value")), f"{cfg.out}/best_metadata"
    )
    best_oof = oof.where(F.col("candidate_id") == winner.candidate_id)
    writers.write_report(E.confusion_matrix(best_oof, "candidate_id"), f"{cfg.out}/best_confusion")
    writers.write_table(
        E.roc_points(best_oof, "candidate_id", scratch=scratch, drop_collinear=True),
        f"{cfg.out}/best_roc",
    )
    analyse(spark, rows, cfg, scratch)
    return model


def analyse(spark: SparkSession, rows: DataFrame, cfg: CompareConfig, scratch: Scratch) -> None:
    """Top weighted terms, keyword lift and the word charts."""
    o = cfg.options
    linear = CV.fit_final(rows, "tfidf", "logistic_regression", o)
    # 120 rows.
    top = scratch.table(
        I.top_weighted_terms(CV.linear_weights(linear), stopwords=o.stopwords), "top-words"
    )
    writers.write_report(top.orderBy("label_name", F.desc(F.abs("weight"))), f"{cfg.out}/top_words")
    writers.write_report(
        I.chart_terms(top).orderBy("label_name", "rank"), f"{cfg.out}/top_words_chart"
    )
    tokens = rows.select("label", X.tokens(F.col("text"), normalized=True).alias("tokens"))
    writers.write_report(I.keyword_counts(tokens, o.seeds), f"{cfg.out}/keyword_counts")
    words = I.content_words(rows, o.stopwords)
    unigrams = scratch.table(I.word_frequencies(words), "word-counts")
    writers.write_report(
        I.word_cloud(words, unigrams=unigrams, scratch=scratch).orderBy("label", F.desc("n"), "term"),
        f"{cfg.out}/word_cloud",
    )


@dataclass(frozen=True)
class ExternalConfig:
    """``logits``: a Parquet table (model_id, row_id, logits). ``models``: those that
    are expected; by default all that the table has. ``settings``: what the log
    shall say about every run, such as a model's longest input."""

    prepared: str
    logits: str
    out: str
    prepared_format: str = "parquet"
    models: tuple[str, ...] = ()
    settings: tuple[tuple[str, str], ...] = ()
    seed: int = 42


def external_run(spark: SparkSession, cfg: ExternalConfig) -> DataFrame:
    """Evaluate external models on the hold-out split. Writes the run log, the
    ranked results, the test predictions, a report for each model and the best
    model's line; returns the ranked results. The log is written even if no model
    has logits for all rows, which is an error."""
    scratch = Scratch(spark)
    source = readers.read_prepared(spark, cfg.prepared, cfg.prepared_format)
    rows = scratch.table(readers.labelled(source).select("row_id", "text", "label"), "labelled")
    held = scratch.table(S.holdout(rows.select("row_id", "label"), cfg.seed), "holdout")
    logits = spark.read.parquet(cfg.logits).select("model_id", "row_id", "logits")
    asked = (
        spark.createDataFrame([(m,) for m in cfg.models], "model_id string")
        if cfg.models
        else logits.select("model_id").distinct()
    )
    runs = EX.external_runs(held, logits, asked, scratch)
    # One row for each model, here and in the log.
    results = scratch.table(runs.results, "external-results")
    logged = results.select(
        "model_id", "slug", *[F.lit(v).alias(k) for k, v in cfg.settings], *results.columns[2:]
    )
    writers.write_json(I.run_log(logged, runs.failures), f"{cfg.out}/run_log")
    flat = EX.flatten(results).withColumn("candidate_id", F.col("model_id"))
    ranked = E.rank_candidates(flat, "test_").drop("candidate_id")
    best = ranked.limit(1)
    if best.isEmpty():
        raise RuntimeError(f"no model has logits for all rows; see {cfg.out}/run_log")
    writers.write_report(ranked, f"{cfg.out}/results")
    test = runs.predictions.where("split = 'test'")
    frame = test.join(rows.select("row_id", "text"), "row_id").withColumn("slug", X.slug(F.col("model_id")))
    writers.write_table(
        writers.prediction_frame(frame, "slug", "row_id"), f"{cfg.out}/test_predictions", partition_by=("slug",)
    )
    reports = E.report_documents(E.class_report(test, "model_id"), "model_id")
    reports = reports.select(X.slug(F.col("model_id")).alias("slug"), *[c for c in reports.columns if c != "model_id"])
    writers.write_table(reports, f"{cfg.out}/reports", "text", ("slug",))
    writers.write_json(
        best.select(writers.document(*best.columns).alias("value")), f"{cfg.out}/best_metadata"
    )
    return ranked


@dataclass(frozen=True)
class RunConfig:
    prepare: PrepareConfig
    compare: CompareConfig
    skip_prepare: bool = False
    skip_compare: bool = False


def run_all(spark: SparkSession, cfg: RunConfig) -> PipelineModel | None:
    if not cfg.skip_prepare:
        prepare(spark, cfg.prepare)
    return None if cfg.skip_compare else compare(spark, cfg.compare)


DASHBOARD = {
    "results": "candidate_id int, feature string, model string, folds int, n bigint, accuracy double,"
    " precision double, recall double, f1 double, roc_auc double",
    "top_words": "term string, weight double, label_name string",
    "keyword_counts": "term string, positif_docs bigint, negatif_docs bigint, positif_rate double,"
    " negatif_rate double, dominant_label string, lift double",
}


def dashboard(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The report tables of a run; those not written yet are empty."""
    tables = {
        name: readers.read_if_present(spark, f"{out}/{name}", T.StructType.fromDDL(schema), "csv")
        for name, schema in DASHBOARD.items()
    }
    path = f"{out}/summary"
    tables["summary"] = (
        spark.read.text(path)
        if path_exists(spark, path)
        else spark.createDataFrame([], "value string")
    )
    return tables

