"""Cross-validated comparison of feature x model candidates, and the final fit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.operators import classifiers as C
from revlens.operators import ml_features as MF
from revlens.operators import terms as TM
from revlens.operators.split import stratified_folds
from revlens.settings import CompareOptions
from revlens.sources.scratch import Scratch, path_exists

OOF_COLUMNS = (
    "candidate_id", "feature", "model", "fold", "row_id", "label", "prediction", "score", "score_kind",
)


# Vectors are long rows. So many of them, at most, are held at once by the JVM and by a
# Python worker, and read as one part of a table.
SMALL = {
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
    "spark.sql.inMemoryColumnarStorage.batchSize": 1000,
    "spark.sql.files.maxPartitionBytes": 32 << 20,
}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is held of the vectors does not grow with the table. What the session sets
    lower stays, and all is as before afterwards."""
    before = {name: spark.conf.get(name) for name in SMALL}
    # Sizes may have a unit.
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    for name, most in SMALL.items():
        own = jvm.byteStringAsBytes(before[name])
        spark.conf.set(name, str(min(own, most) if own > 0 else most))
    try:
        yield
    finally:
        for name, own in before.items():
            spark.conf.set(name, own)


@dataclass(frozen=True)
class Candidate:
    candidate_id: int
    feature: str
    model: str


def grid(options: CompareOptions) -> list[Candidate]:
    pairs = [(f, m) for f in options.features for m in options.models]
    return [Candidate(i, f, m) for i, (f, m) in enumerate(pairs, start=1)]


@dataclass
class Comparison:
    """``predictions``: out-of-fold rows of the candidates that finished;
    ``status``: (candidate_id, feature, model, status, error)."""

    predictions: DataFrame
    status: DataFrame


class Progress:
    """The finished folds of a comparison, each a table in ``folder``.

    A fold counts as finished when its table is committed, which the file system
    does in one step; what a lost run left half-written is written anew. Folds
    are found again only for the same rows and the same options.
    """

    def __init__(self, rows: DataFrame, options: CompareOptions, folder: str):
        # Which candidates are asked for, and how they are run, changes no fold.
        o = replace(options, features=(), models=(), parallel_fits=1, stop_on_error=False)
        facts = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("row_id", "text", "label").cast("decimal(38,0)")))
        key = repr((o, tuple(facts.first())))
        self.spark = rows.sparkSession
        self.folder = f"{folder}/{hashlib.sha256(key.encode()).hexdigest()[:16]}"

    def path(self, c: Candidate, fold: int) -> str:
        return f"{self.folder}/{c.feature}/{c.model}/{fold}"

    def done(self, c: Candidate, fold: int) -> bool:
        return path_exists(self.spark, f"{self.path(c, fold)}/_SUCCESS")


def _fold_entries(
    rows: DataFrame, o: CompareOptions, scratch: Scratch | None = None
) -> dict[int, list[tuple[str, float]]]:
    """fold -> (term, idf) in alphabetical order. All vocabularies come from one
    pass over the corpus; folds x max_features rows."""
    terms = TM.with_terms(rows.select("fold", "text"))
    by_fold: dict[int, list] = {}
    vocab = TM.fold_vocabularies(terms, o.folds, o.tfidf, scratch)
    # By columns: a row of Python objects each would take several times as much.
    for batch in vocab.select("fold", "term", "idf").toArrow().to_batches():
        for fold, *entry in zip(*(column.to_pylist() for column in batch.columns)):
            by_fold.setdefault(fold, []).append(tuple(entry))
    return {fold: sorted(entries) for fold, entries in by_fold.items()}


def _fold_vectorizers(rows: DataFrame, feature: str, o: CompareOptions):
    """fold -> fitted feature stages; word vectors are trained per fold, seeded
    seed + fold."""
    if feature == "tfidf":
        by_fold = _fold_entries(rows, o)

        def tfidf(fold: int) -> PipelineModel:
            if fold not in by_fold:
                raise ValueError("no term reaches the smallest document frequency")
            return PipelineModel(stages=MF.tfidf_stages(*map(list, zip(*by_fold[fold]))))

        return tfidf

    def word2vec(fold: int) -> PipelineModel:
        train = rows.where(F.col("fold") != fold)
        return MF.ReviewVectors(o.word2vec, o.seed + fold).fit(train)

    return word2vec


def _fold_vectors(rows: DataFrame, feature: str, o: CompareOptions, scratch: Scratch) -> Callable[[int], DataFrame]:
    """fold -> (row_id, label, fold, features) of all rows. TF-IDF counts the terms
    of each text once for all folds."""
    if feature == "tfidf":
        by_fold = _fold_entries(rows, o, scratch)
        counts = MF.FoldTfidf(rows, by_fold, scratch) if by_fold else None

        def tfidf(fold: int) -> DataFrame:
            if fold not in by_fold:
                raise ValueError("no term reaches the smallest document frequency")
            return counts.vectors(fold)

        return tfidf
    make = _fold_vectorizers(rows, feature, o)
    return lambda fold: make(fold).transform(rows).select("row_id", "label", "fold", "features")


def compare(
    rows: DataFrame, options: CompareOptions, scratch: Scratch, folder: str | None = None
) -> Comparison:
    """Fit every candidate on every fold and collect the out-of-fold predictions.

    The driver only submits fits: ``parallel_fits`` at a time, so that the tail
    of one overlaps the start of the next; the folds run side by side. Features are
    computed once per (feature, fold) and shared by all models. Each finished fold is a table in
    the shared folder; a candidate that fails is reported and the rest go on.
    With ``folder``, folds that an earlier run finished there are not fitted again.
    """
    o = options
    progress = Progress(rows, o, folder or scratch.path("progress"))
    folded = scratch.table(
        stratified_folds(rows.select("row_id", "text", "label"), o.folds, o.seed), "folds"
    )
    # folds x classes rows.
    counts = {
        (r.fold, r.label): r.n
        for r in folded.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    candidates = grid(o)
    errors: dict[int, str] = {}

    def one_fold(c: Candidate, fold: int, data: DataFrame, class_n: dict[int, int]) -> None:
        if c.candidate_id in errors:
            return
        try:
            train = data.where(F.col("fold") != fold)
            weighted = train.withColumn(C.WEIGHT, C.balanced_weight(class_n))
            model = C.classifier(c.model, o, sum(class_n.values())).fit(weighted)
            valid = C.predict(model, data.where(F.col("fold") == fold))
            out = valid.select(
                F.lit(c.candidate_id).alias("candidate_id"),
                F.lit(c.feature).alias("feature"),
                F.lit(c.model).alias("model"),
                "fold", "row_id", "label", "prediction", "score", "score_kind",
            )
            out.write.mode("overwrite").parquet(progress.path(c, fold))
        except Exception as error:  # a failed candidate must not stop the others
            if o.stop_on_error:
                raise
            errors[c.candidate_id] = repr(error)

    def whole_fold(group: list[Candidate], vectors: Callable[[int], DataFrame], fold: int) -> None:
        left = [c for c in group if c.candidate_id not in errors and not progress.done(c, fold)]
        if not left:
            return
        class_n: dict[int, int] = {}
        for (f, label), n in counts.items():
            if f != fold:
                class_n[label] = class_n.get(label, 0) + n
        try:
            # Fits read them a few times, and keep what they read often in their own way.
            data = vectors(fold).persist(StorageLevel.DISK_ONLY)
        except Exception as error:
            if o.stop_on_error:
                raise
            errors.update({c.candidate_id: repr(error) for c in group})
            return
        try:
            for c in left:
                one_fold(c, fold, data, class_n)
        finally:
            data.unpersist()

    with small_batches(rows.sparkSession):
        for feature in o.features:
            group = [c for c in candidates if c.feature == feature]
            if all(progress.done(c, fold) for c in group for fold in range(1, o.folds + 1)):
                continue
            vectors = _fold_vectors(folded, feature, o, scratch)
            # Folds side by side: a query of one candidate has no other fits to submit.
            with ThreadPoolExecutor(o.parallel_fits) as pool:
                jobs = [pool.submit(whole_fold, group, vectors, fold) for fold in range(1, o.folds + 1)]
                try:
                    for job in jobs:
                        job.result()
                except Exception:
                    pool.shutdown(cancel_futures=True)
                    raise

    spark = rows.sparkSession
    status = spark.createDataFrame(
        [
            (c.candidate_id, c.feature, c.model,
             "failed" if c.candidate_id in errors else "done", errors.get(c.candidate_id))
            for c in candidates
        ],
        "candidate_id int, feature string, model string, status string, error string",
    )
    done = [
        spark.read.parquet(*[progress.path(c, fold) for fold in range(1, o.folds + 1)]).withColumn(
            "candidate_id", F.lit(c.candidate_id)
        )
        for c in candidates
        if c.candidate_id not in errors
    ]
    if not done:
        raise RuntimeError(f"every candidate failed: {errors}")
    return Comparison(stack(done).select(*OOF_COLUMNS), status)


def fit_final(rows: DataFrame, feature: str, model: str, options: CompareOptions) -> PipelineModel:
    """Text-to-prediction pipeline fitted on all rows."""
    counts = {
        r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    if feature == "tfidf":
        # Texts are tokenised once, not for the vocabulary and again for the vectors.
        words = MF.TfidfTraining(rows.select("row_id", "label", "text"), options.tfidf, Scratch(rows.sparkSession))
        stages, vectors, done = words.model, words.vectors(), words.close
    else:
        stages = MF.feature_estimator(feature, options.tfidf, options.word2vec, options.seed).fit(rows)
        vectors, done = stages.transform(rows), lambda: None
    train = (
        vectors.select("row_id", "label", "features")
        .withColumn(C.WEIGHT, C.balanced_weight(counts))
        # Read once per pass of the solver.
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        fitted = C.classifier(model, options, sum(counts.values())).fit(train)
    finally:
        train.unpersist()
        done()
    return PipelineModel(stages=[*stages.stages, fitted])


def linear_weights(model: PipelineModel) -> DataFrame:
    """(term, weight) of a TF-IDF pipeline with a linear classifier. The
    coefficients are one number per vocabulary term."""
    vocab = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    weights = model.stages[-1].coefficients.toArray().tolist()
    return SparkSession.active().createDataFrame(
        list(zip(vocab, weights)), "term string, weight double"
    )


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames, matched by column name."""
    first, *rest = list(frames)
    for frame in rest:
        first = first.unionByName(frame)
    return first
