"""Every registered query with an exact answer, next to its SQL."""

import pytest

import __spark_entry__ as entry
from revlens.plans import catalog, oracles
from check_oracles import compare, connect
from tests.conftest import SF_DIR

SQL = oracles.sql()
QUERIES = catalog.registered()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "w2v_vectors", "lr_top_words", "cv_grid", "score_reviews", "stream_scores",
        "cv_logistic_regression", "cv_linear_svm", "cv_random_forest", "cv_extra_trees",
        "cv_gradient_boosting",
    }


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    result = df.toPandas()
    assert len(result) > 0
    assert compare(result, duck.sql(SQL[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 120


@pytest.mark.parametrize("name", ["w2v_vectors", "lr_top_words", "score_reviews"])
def test_model_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
