"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.operators import evaluate as E
from revlens.operators import insights as I
from revlens.operators import ml_features as MF
from revlens.operators import prepare as P
from revlens.operators import split as S
from revlens.operators import terms as TM


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+)", plan(df))


def test_columns_are_pruned(inputs):
    text = plan(P.label_counts(inputs.prepared))
    assert "ReadSchema: struct<label_name:string>" in text


def test_label_filter_reaches_the_scan(inputs):
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,1)]" in plan(P.class_texts(inputs.prepared, 1))


def test_deduplication_does_not_shuffle_rows(inputs, scratch):
    usable = scratch.table(P.usable_rows(P.tag_rows(inputs.raw)), "usable")
    text = plan(P.deduplicated(usable, scratch))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_summary_shuffles_digests_only(inputs, scratch):
    tagged = scratch.table(P.tag_rows(inputs.raw), "tagged")
    text = plan(P.summarize(tagged))
    assert "text" not in re.search(r"ReadSchema: (.*)", text).group(1)
    assert "SortAggregate" not in text


def test_tokens_are_computed_once_per_row(inputs):
    docs = inputs.prepared.select("row_id", "text")
    assert plan(TM.term_stats(TM.with_terms(docs))).count("regexp_extract_all") == 1


def test_tfidf_shuffles_no_text(inputs, scratch):
    docs = inputs.prepared.select("row_id", "text")
    vocab = scratch.table(TM.vocabulary(TM.with_terms(docs), docs.count()), "v")
    assert "hashpartitioning" not in exchanges(TM.weigh(docs, vocab))
    rows = vocab.orderBy("idx").collect()
    vectors = docs
    for stage in MF.tfidf_stages([r.term for r in rows], [r.idf for r in rows]):
        vectors = stage.transform(vectors)
    assert "hashpartitioning" not in plan(MF.long_weights(vectors, vocab))


def test_keywords_explode_seeds_only(inputs):
    tokens = inputs.prepared.select("label", X.tokens(F.col("text"), normalized=True).alias("tokens"))
    assert "explode(concat(array_intersect" in plan(I.keyword_counts(tokens))


def test_no_window_over_a_whole_class(inputs):
    """Rows are ranked inside hash ranges; only range counts meet in one task."""
    text = plan(S.with_class_rank(inputs.prepared.select("row_id", "label")))
    rank = next(line for line in text.splitlines() if "row_number()" in line)
    assert re.search(r"windowspecdefinition\(label#\d+, _range#\d+", rank)


def test_auc_windows_are_bounded(inputs, scratch):
    scores = scratch.table(E.score_table(inputs.scored, "candidate_id"), "s")
    text = plan(E.metrics_of(scores, "candidate_id"))
    windows = [line for line in text.splitlines() if "windowspecdefinition" in line and "+- Window" in line]
    assert len(windows) == 2
    assert any(re.search(r"windowspecdefinition\(candidate_id#\d+, range#\d+", w) for w in windows)


def test_large_top_k_ranks_parts_of_a_group_first(inputs):
    words = I.word_frequencies(I.content_words(inputs.prepared))
    text = plan(I.top_words(words, 12000))
    assert re.search(r"hashpartitioning\(label#\d+, _part#\d+", text)
    assert re.search(r"windowspecdefinition\(label#\d+, _part#\d+", text)


@pytest.mark.parametrize("limit", [20, 120])
def test_top_k_is_limited_before_the_shuffle(inputs, limit):
    words = I.word_frequencies(I.content_words(inputs.prepared))
    assert "WindowGroupLimit" in plan(I.top_words(words, limit))


def test_holdout_moves_no_rows(inputs):
    """Beyond range counts and the ranges of the cuts, rows stay where they are."""
    rows = inputs.prepared.select("row_id", "label")
    found = S.holdout(rows)._jdf.queryExecution().optimizedPlan().toString()
    top = found.split("Join LeftOuter")
    assert len(top) == 2 and "rightHint=(strategy=broadcast)" in top[1].splitlines()[0]
    assert "Window" not in top[0] and "Aggregate" not in top[0]
    # The rows' own side is a plain scan.
    left = top[1].splitlines()[1]
    assert "Relation" in left or "Project" in left
