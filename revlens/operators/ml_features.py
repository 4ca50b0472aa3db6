"""Feature stages for MLlib pipelines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.functions import text as X
from revlens.functions.vectors import vector_values
from revlens.operators import terms as TM
from revlens.operators.skew import skew_join
from revlens.operators.vectors import dense_vectors, sparse_vectors
from revlens.operators.word2vec import Trainer
from revlens.settings import TfidfOptions, Word2VecOptions
from revlens.sources.scratch import Scratch


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    inputCol = Param(Params._dummy(), "inputCol", "input column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    def _in(self) -> str:
        return self.getOrDefault(self.inputCol)

    def _out(self) -> str:
        return self.getOrDefault(self.outputCol)


class ReviewTokens(_Stage):
    """Text to tokens; with ``pairs`` also adjacent pairs."""

    pairs = Param(Params._dummy(), "pairs", "add bigrams", TypeConverters.toBoolean)
    minLen = Param(Params._dummy(), "minLen", "shortest token", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, pairs=None, minLen=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="terms", pairs=False, minLen=2)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        words = X.tokens(F.col(self._in()), min_len=self.getOrDefault(self.minLen))
        out = df.withColumn(self._out(), words)
        if self.getOrDefault(self.pairs):
            out = out.withColumn(self._out(), X.with_bigrams(F.col(self._out())))
        return out


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and the row of each value."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(
        np.arange(len(column)), lengths
    )


def _with_values(vectors: pa.StructArray, values: np.ndarray) -> pa.StructArray:
    kind, size, indices, old = vectors.flatten()
    offsets = old.offsets.to_numpy()
    new = pa.ListArray.from_arrays(
        pa.array(offsets - offsets[0], type=pa.int32()), pa.array(values, type=pa.float64())
    )
    return pa.StructArray.from_arrays(
        [kind, size, indices, new.cast(old.type)], fields=list(vectors.type)
    )


def _weigh_counts(idf: list[float]):
    """Arrow function over whole batches of sparse count vectors: MLlib has no
    sublinear term frequency, and no SQL expression builds a vector."""
    table = np.asarray(idf)

    @F.arrow_udf(VectorUDT())
    def weigh(vectors: pa.Array) -> pa.Array:
        _, _, indices, counts = vectors.flatten()
        tf, row = _lists(counts)
        index, _ = _lists(indices)
        raw = (1.0 + np.log(tf)) * table[index]
        norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=len(vectors)))
        return _with_values(vectors, raw / norm[row])

    return weigh


class SublinearTfidf(_Stage):
    """Count vectors to unit-length sublinear TF-IDF vectors."""

    idf = Param(Params._dummy(), "idf", "idf by index", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, idf=None):
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        weigh = _weigh_counts(self.getOrDefault(self.idf))
        return df.withColumn(self._out(), weigh(F.col(self._in())))


def tfidf_stages(vocab: list[str], idf: list[float]) -> list[Transformer]:
    """Stages for a known vocabulary. Vectorising is then a map over rows: no
    shuffle, whatever the number of documents."""
    counts = CountVectorizerModel.from_vocabulary(vocab, inputCol="terms", outputCol="counts")
    return [
        ReviewTokens(pairs=True),
        counts,
        SublinearTfidf(idf=idf),
    ]


def _weigh_folds(entries: dict[int, tuple[list[int], list[float]]], size: int, fold: int):
    """Arrow function from counts of a shared vocabulary to the vectors of one fold,
    whose terms have ``entries``: places in the shared vocabulary, ascending, and idf."""
    places, idf = (np.asarray(x) for x in entries[fold])
    number = np.full(size, -1, np.int32)
    number[places] = np.arange(len(places))
    table = np.asarray(idf, np.float64)

    @F.arrow_udf(VectorUDT())
    def weigh(indices: pa.Array, counts: pa.Array) -> pa.Array:
        tf, row = _lists(counts)
        index, _ = _lists(indices)
        at = number[index]
        known = at >= 0
        at, tf, row = at[known], tf[known], row[known]
        raw = (1.0 + np.log(tf)) * table[at]
        norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=len(counts)))
        return sparse_vectors(len(table), row, at, raw / norm[row], len(counts))

    return weigh


class FoldTfidf:
    """TF-IDF vectors of all folds from one count of each text. ``vocabularies``:
    fold -> (term, idf) in alphabetical order, which come to the driver anyway. Their
    union is counted once; a fold picks its own terms and weighs them, so its vectors
    are those of ``tfidf_stages``."""

    def __init__(self, rows: DataFrame, vocabularies: dict[int, list[tuple[str, float]]], scratch: Scratch):
        union = sorted({term for entries in vocabularies.values() for term, _ in entries})
        place = {term: k for k, term in enumerate(union)}
        self.size = len(union)
        self.entries = {
            fold: ([place[t] for t, _ in found], [idf for _, idf in found]) for fold, found in vocabularies.items()
        }
        terms = ReviewTokens(pairs=True).transform(rows)
        counter = CountVectorizerModel.from_vocabulary(union, inputCol="terms", outputCol="counts")
        vector = vector_values(F.col("counts"))
        counted = counter.transform(terms).select(
            "row_id", "label", "fold", vector["indices"].alias("indices"), vector["values"].alias("counts")
        )
        self.counted = scratch.table(counted, "fold-counts")

    def vectors(self, fold: int) -> DataFrame:
        weigh = _weigh_folds(self.entries, self.size, fold)
        return self.counted.select("row_id", "label", "fold", weigh("indices", "counts").alias("features"))


class TfidfVectorizer(Estimator):
    """Fit a vocabulary of at most ``max_features`` terms; that many rows come
    to the driver, as for any MLlib vocabulary."""

    def __init__(self, options: TfidfOptions = TfidfOptions(), *, normalized: bool = False):
        super().__init__()
        self.options = options
        self.normalized = normalized

    def _fit(self, docs: DataFrame) -> PipelineModel:
        terms = TM.with_terms(docs.select("text"), normalized=self.normalized)
        vocab = TM.vocabulary(terms, docs.count(), self.options).orderBy("idx")
        rows = vocab.select("term", "idf").collect()
        if not rows:
            raise ValueError("no term reaches the smallest document frequency")
        return PipelineModel(stages=tfidf_stages([r.term for r in rows], [r.idf for r in rows]))


class TfidfTraining:
    """A TF-IDF fit and its features, from one look at the texts: their words are
    written, and both the vocabulary and the vectors come from them. The result is
    that of ``TfidfVectorizer``; ``close`` deletes the words."""

    def __init__(self, rows: DataFrame, options: TfidfOptions, scratch: Scratch):
        kept = ReviewTokens(outputCol="words").transform(rows).drop("text")
        self.words, self.scratch = scratch.table(kept, "words"), scratch
        vocab = TM.vocabulary(self._terms().select("terms"), self.words.count(), options)
        found = vocab.orderBy("idx").select("term", "idf").collect()
        if not found:
            raise ValueError("no term reaches the smallest document frequency")
        self.model = PipelineModel(stages=tfidf_stages([r.term for r in found], [r.idf for r in found]))

    def _terms(self) -> DataFrame:
        return self.words.withColumn("terms", X.with_bigrams(F.col("words"))).drop("words")

    def vectors(self) -> DataFrame:
        return PipelineModel(stages=self.model.stages[1:]).transform(self._terms())

    def close(self) -> None:
        self.scratch.drop(self.words)


def long_weights(vectorized: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row_id, term, tf, weight) from the vectors, as ``terms.weigh`` gives, but
    without any shuffle. The vocabulary (idx, term) has at most max_features rows."""
    counts, features = (vector_values(F.col(c)) for c in ("counts", "features"))
    entries = F.arrays_zip(
        counts["indices"].alias("idx"),
        counts["values"].alias("tf"),
        features["values"].alias("weight"),
    )
    return (
        vectorized.select("row_id", F.inline_outer(entries))
        .join(F.broadcast(vocab.select("idx", "term")), "idx")
        .select("row_id", "term", F.col("tf").cast("bigint").alias("tf"), "weight")
    )


def _means(words: dict[str, int], matrix: np.ndarray):
    """Arrow function from tokens to the mean vector of the known ones."""
    size = matrix.shape[1]
    shared = SparkSession.active().sparkContext.broadcast((words, matrix))

    @F.arrow_udf(VectorUDT())
    def mean(tokens: pa.Array) -> pa.Array:
        words, matrix = shared.value
        row = np.repeat(np.arange(len(tokens)), pa.compute.fill_null(pa.compute.list_value_length(tokens), 0))
        coded = tokens.flatten().dictionary_encode()
        number = np.array([words.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
        at = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        row, at = row[at >= 0], at[at >= 0]
        sums = np.zeros((len(tokens), size))
        # In steps, so that a long batch is never one large matrix.
        for begin in range(0, len(at), 65_536):
            part, vectors = row[begin : begin + 65_536], matrix[at[begin : begin + 65_536]]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            sums[part[starts]] += np.add.reduceat(vectors, starts, dtype=np.float64)
        counts = np.bincount(row, minlength=len(tokens))
        return dense_vectors(sums / np.maximum(counts, 1)[:, None])

    return mean


class _WithTable(MLWriter):
    """Writes the parameters and, next to them, the table of vectors."""

    def __init__(self, stage: WordMeans):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.table(self.sparkSession).write.parquet(f"{path}/vectors")


class _TableReader(MLReader):
    def load(self, path: str) -> WordMeans:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = WordMeans()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage._set(path=f"{path}/vectors")
        return stage


class WordMeans(Transformer, MLWritable, MLReadable):
    """The mean vector of a text's known tokens; a text without any gets zeros.

    The vectors are a table (word, vector) at ``path``. If its size allows, it is
    broadcast and no row moves. A larger one is joined with the tokens, the hot
    words of which are split over many tasks; that needs a batch table.
    """

    inputCol = Param(Params._dummy(), "inputCol", "tokens", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vectors", TypeConverters.toString)
    path = Param(Params._dummy(), "path", "table of word vectors", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "vector size", TypeConverters.toInt)
    broadcastBytes = Param(Params._dummy(), "broadcastBytes", "largest broadcast", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, path=None, size=None, broadcastBytes=None):
        super().__init__()
        self._setDefault(inputCol="terms", outputCol="features", broadcastBytes=128 << 20)
        self._set(**self._input_kwargs)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word string, vector array<float>").parquet(self.getOrDefault(self.path))

    def getVectors(self) -> DataFrame:
        """(word, vector), as ML vectors."""
        table = self.table(SparkSession.active())
        return table.select("word", array_to_vector(F.col("vector").cast("array<double>")).alias("vector"))

    def write(self) -> MLWriter:
        return _WithTable(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        size = self.getOrDefault(self.size)
        table = self.table(df.sparkSession)
        # A word takes some hundred bytes in a dictionary.
        if table.count() * (4 * size + 100) > self.getOrDefault(self.broadcastBytes):
            return self._joined(df, table)
        known = table.toArrow()
        words = {w: k for k, w in enumerate(known.column("word").to_pylist())}
        vectors = known.column("vector").combine_chunks()
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        mean = _means(words, matrix)
        return df.withColumn(self.getOrDefault(self.outputCol), mean(F.col(self.getOrDefault(self.inputCol))))

    def _joined(self, df: DataFrame, table: DataFrame) -> DataFrame:
        if df.isStreaming:
            raise ValueError("the word vectors are too large to broadcast into a stream")
        scratch = Scratch(df.sparkSession)
        rows = scratch.table(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        tokens = rows.select("_row", F.explode(self.getOrDefault(self.inputCol)).alias("word"))
        known = skew_join(scratch.table(tokens, "tokens"), table, ["word"], F.col("_row"))
        vector = array_to_vector(F.col("vector").cast("array<double>"))
        means = known.groupBy("_row").agg(Summarizer.mean(vector).alias("_mean"))
        none = array_to_vector(F.array_repeat(F.lit(0.0), self.getOrDefault(self.size)))
        joined = rows.join(means, "_row", "left").withColumn(
            self.getOrDefault(self.outputCol), F.coalesce("_mean", none)
        )
        return joined.drop("_row", "_mean")


class ReviewVectors(Estimator):
    """Skip-gram word vectors and their mean per text, over rows (row_id, text).
    Vectors stay in a table; see ``word2vec``."""

    def __init__(
        self,
        options: Word2VecOptions = Word2VecOptions(),
        seed: int = 42,
        scratch: Scratch | None = None,
    ):
        super().__init__()
        self.options = options
        self.seed_value = seed
        self.scratch = scratch

    def _fit(self, docs: DataFrame) -> PipelineModel:
        o = self.options
        scratch = self.scratch or Scratch(docs.sparkSession)
        split = ReviewTokens()
        vectors = Trainer(o, self.seed_value, scratch).fit(split.transform(docs.select("text")))
        pooled = WordMeans(
            path=scratch.path_of(vectors), size=o.vector_size, broadcastBytes=o.broadcast_bytes
        )
        return PipelineModel(stages=[split, pooled])


def feature_estimator(name: str, tfidf: TfidfOptions, w2v: Word2VecOptions, seed: int) -> Estimator:
    if name == "tfidf":
        return TfidfVectorizer(tfidf)
    if name == "word2vec":
        return ReviewVectors(w2v, seed)
    raise ValueError(f"unsupported feature: {name}")
