"""What separates the classes: keywords, word frequencies, collocations, top terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.functions import text as X
from revlens.functions.rows import each, largest
from revlens.functions.vectors import signed_weight
from revlens.operators.skew import heavy_keys, skew_join
from revlens.settings import KEYWORD_SEEDS, STOPWORDS
from revlens.sources.scratch import Scratch

_TINY = 1e-9


def keyword_lift(counts: DataFrame) -> DataFrame:
    """Rates, dominant label and lift from (term, positif_docs, negatif_docs,
    pos_total, neg_total)."""

    def rate(part: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(part) / F.col(total)).otherwise(0.0)

    return (
        counts.withColumn("positif_rate", rate("positif_docs", "pos_total"))
        .withColumn("negatif_rate", rate("negatif_docs", "neg_total"))
        .select(
            "term",
            "positif_docs",
            "negatif_docs",
            "positif_rate",
            "negatif_rate",
            F.when(F.col("positif_rate") >= F.col("negatif_rate"), "Positif")
            .otherwise("Negatif")
            .alias("dominant_label"),
            ((F.col("positif_rate") + _TINY) / (F.col("negatif_rate") + _TINY)).alias("lift"),
        )
    )


def keyword_counts(docs: DataFrame, seeds: Sequence[str] = KEYWORD_SEEDS) -> DataFrame:
    """Documents per class that contain each seed word, with rates and lift.

    ``docs`` has ``label`` and ``tokens``. The seeds are intersected with the
    tokens inside each row, so no other token is ever exploded, and a NULL
    entry per row counts the class totals in the same pass. The shuffle moves
    one row per seed and task.
    """
    wanted = F.array(*[F.lit(s) for s in seeds])
    # array_intersect also removes repeats.
    found = F.concat(F.array_intersect("tokens", wanted), F.array(F.lit(None).cast("string")))
    counts = (
        docs.select("label", F.explode_outer(found).alias("term"))
        .groupBy("term")
        .agg(
            F.count_if(F.col("label") == 1).alias("positif_docs"),
            F.count_if(F.col("label") == 0).alias("negatif_docs"),
        )
    )
    # One row per seed and one for the totals.
    every = Window.partitionBy(F.lit(1))
    is_total = F.col("term").isNull()
    counts = (
        counts.withColumn("pos_total", F.max(F.when(is_total, F.col("positif_docs"))).over(every))
        .withColumn("neg_total", F.max(F.when(is_total, F.col("negatif_docs"))).over(every))
        .where(~is_total & (F.col("positif_docs") + F.col("negatif_docs") > 0))
    )
    return order_keywords(keyword_lift(counts))


def order_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.orderBy(
        F.desc("dominant_label"), F.desc("lift"), F.desc("positif_docs"), F.desc("negatif_docs"), "term"
    )


def content_words(
    docs: DataFrame, stopwords: Sequence[str] = STOPWORDS, *, normalized: bool = True
) -> DataFrame:
    """(label, words): tokens of three letters or more that are no stopwords."""
    words = X.tokens(F.col("text"), min_len=3, stopwords=stopwords, normalized=normalized)
    return docs.select("label", words.alias("words"))


def word_frequencies(words: DataFrame) -> DataFrame:
    """(label, term, n) from ``content_words``."""
    return (
        each(words, "words", "label", name="term")
        .groupBy("label", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_words(counts: DataFrame, limit: int = 120) -> DataFrame:
    """The most frequent terms per class, scaled to the first one."""
    best = largest(counts, limit, "label", by=(F.desc("n"), F.col("term")), key="term")
    # At most `limit` rows per class.
    biggest = F.max("n").over(Window.partitionBy("label"))
    return best.select("label", "term", "n", (F.col("n") / biggest).alias("relative"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    floor = F.lit(1e-10)
    return F.log(F.greatest(p, floor)) * k + F.log(F.greatest(1 - p, floor)) * (n - k)


def dunning(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two words being neighbours; 0 if one
    word is all there is."""
    independent = second / total
    after = pair / first
    elsewhere = (second - pair) / (total - first)
    ratio = (
        _log_likelihood(pair, first, independent)
        + _log_likelihood(second - pair, total - first, independent)
        - _log_likelihood(pair, first, after)
        - _log_likelihood(second - pair, total - first, elsewhere)
    )
    return F.when((total <= first) | (total <= second), 0.0).otherwise(-2.0 * ratio)


def collocations(
    words: DataFrame, unigrams: DataFrame | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """(label, first, second, n, score) for neighbouring content words of a text.

    Pair counts meet the word counts through two equi-joins on (label, word). A
    word that stands in a large part of the pairs is split over many tasks by
    the other word of the pair; the word side is unique.
    """
    scratch = scratch or Scratch(words.sparkSession)
    unigrams = scratch.table(word_frequencies(words), "words") if unigrams is None else unigrams
    pairs = (
        each(words, X.bigrams(F.col("words")), "label", name="pair")
        .groupBy("label", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "label",
            F.substring_index("pair", " ", 1).alias("first"),
            F.substring_index("pair", " ", -1).alias("second"),
            "n",
        )
    )
    pairs = scratch.table(pairs, "pairs")
    firsts = unigrams.select("label", F.col("term").alias("first"), F.col("n").alias("n_first"))
    seconds = unigrams.select("label", F.col("term").alias("second"), F.col("n").alias("n_second"))
    # One row per class.
    totals = unigrams.groupBy("label").agg(F.sum("n").alias("total"))
    # Every pair finds its words, so the hot keys of the second join are known too.
    on = (["label", "first"], ["label", "second"])
    hot = [heavy_keys(pairs, keys) for keys in on]
    joined = skew_join(pairs, firsts, on[0], F.col("second"), heavy=hot[0])
    joined = skew_join(joined, seconds, on[1], F.col("first"), heavy=hot[1])
    joined = joined.join(F.broadcast(totals), "label")
    score = dunning(*[F.col(c).cast("double") for c in ("n", "n_first", "n_second", "total")])
    return joined.select("label", "first", "second", "n", score.alias("score"))


def word_cloud(
    words: DataFrame,
    limit: int = 120,
    threshold: float = 30.0,
    unigrams: DataFrame | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Top words per class with strong collocations as terms of their own.

    The count of a collocation is taken off the counts of both its words, and
    words with nothing left disappear.
    """
    scratch = scratch or Scratch(words.sparkSession)
    if unigrams is None:
        # Tokens cost far more than reading them back for the pairs.
        words = scratch.table(words, "content-words")
        unigrams = scratch.table(word_frequencies(words), "words")
    strong = collocations(words, unigrams, scratch).where(F.col("score") > threshold)
    taken = F.array(
        F.struct(F.col("first").alias("term"), (-F.col("n")).alias("n")),
        F.struct(F.col("second").alias("term"), (-F.col("n")).alias("n")),
        F.struct(F.concat("first", F.lit(" "), "second").alias("term"), F.col("n").alias("n")),
    )
    changes = strong.select("label", F.inline(taken))
    counts = (
        unigrams.select("label", "term", "n")
        .unionByName(changes)
        .groupBy("label", "term")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
    )
    return top_words(counts, limit)


def top_weighted_terms(
    weights: DataFrame, limit: int = 60, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """(term, weight, label_name): the meaningful terms with the largest weights
    as Positif and with the smallest as Negatif."""
    kept = weights.where(X.is_meaningful(F.col("term"), stopwords)).select("term", "weight")
    positive = kept.orderBy(F.desc("weight"), "term").limit(limit)
    negative = kept.orderBy(F.asc("weight"), "term").limit(limit)
    return positive.withColumn("label_name", F.lit("Positif")).unionByName(
        negative.withColumn("label_name", F.lit("Negatif"))
    )


def chart_terms(terms: DataFrame, limit: int = 20) -> DataFrame:
    """The strongest terms per class with the sign of their class."""
    signed = terms.withColumn("signed_weight", signed_weight(F.col("label_name"), F.col("weight")))
    order = Window.partitionBy("label_name").orderBy(F.desc(F.abs("signed_weight")), "term")
    return (
        signed.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("label_name", "rank", "term", "signed_weight")
    )


HISTORY_SCHEMA = "array<struct<epoch: double, step: double, loss: double, eval_loss: double>>"


def history_series(logs: DataFrame, *keys: str, column: str = "log_history") -> DataFrame:
    """(keys, series, x, y) from a JSON array of log entries: ``x`` is the epoch,
    or the step if there is none; entries without the value are left out."""
    entries = logs.select(*keys, F.inline(F.from_json(column, HISTORY_SCHEMA)))
    x = F.coalesce("epoch", "step")
    both = F.array(
        F.struct(F.lit("train").alias("series"), x.alias("x"), F.col("loss").alias("y")),
        F.struct(F.lit("eval").alias("series"), x.alias("x"), F.col("eval_loss").alias("y")),
    )
    return entries.select(*keys, F.inline(both)).where("y IS NOT NULL")


RUN_LOG_SCHEMA = (
    "results array<struct<model_id: string, slug: string, eval_metrics: map<string, double>,"
    " test_metrics: struct<accuracy: double, precision: double, recall: double, f1: double,"
    " roc_auc: double>>>, failures array<struct<model_id: string, error: string>>"
)


def run_log(results: DataFrame, failures: DataFrame) -> DataFrame:
    """One JSON document with all finished and failed candidates. Both inputs
    have one row per candidate: (model_id, slug, test_metrics) and (model_id, error).
    Further columns of the results, such as row counts and options, go with them."""
    done = results.select(
        F.struct("model_id", *[c for c in results.columns if c != "model_id"]).alias("result"),
        F.lit(None).cast("struct<model_id: string, error: string>").alias("failure"),
    )
    failed = failures.select(
        F.lit(None).cast(done.schema["result"].dataType).alias("result"),
        F.struct("model_id", "error").alias("failure"),
    )
    both = done.unionByName(failed)
    return both.agg(
        F.to_json(
            F.struct(
                F.sort_array(F.collect_list("result")).alias("results"),
                F.sort_array(F.collect_list("failure")).alias("failures"),
            )
        ).alias("value")
    )


def flatten_runs(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per finished candidate with ``test_`` metrics."""
    runs = documents.select(F.from_json(column, RUN_LOG_SCHEMA).alias("log")).select(
        F.inline("log.results")
    )
    names = ("accuracy", "precision", "recall", "f1", "roc_auc")
    return runs.select(
        "model_id", "slug", *[F.col(f"test_metrics.{n}").alias(f"test_{n}") for n in names]
    )
