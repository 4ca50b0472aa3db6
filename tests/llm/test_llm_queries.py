import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from revlens.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.registered())
    assert numbers == list(range(1, 14))
    assert {"pipeline", *queries.registered()} <= set(entry.queries())
    assert set(oracles.sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(oracles.sql()))
def test_query_matches_sql(spark, name):
    con: duckdb.DuckDBPyConnection = connect(SF_DIR)
    result = queries.registered()[name](spark, SF_DIR).toPandas()
    assert compare(result, con.sql(oracles.sql()[name]).df()) == "ok"
