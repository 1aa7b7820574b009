"""Each registered query of the search routes against its DuckDB form."""

import duckdb
import numpy as np
import pytest

from sparkseek.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def shown(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, x)) + "]"
    if x is None or isinstance(x, (float, np.floating)) and np.isnan(x):
        return "~"
    return f"{x:.9g}" if isinstance(x, (float, np.floating)) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_duckdb(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(shown, r)) for r in d[columns].itertuples(index=False)) for d in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    out = QUERIES[name](spark, small).toPandas()
    if name == "hybrid_reconciled":
        assert out["agrees"].all()
    elif name == "dense_regions_recall":
        assert out["recall"][0] >= 0.9


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


@pytest.mark.parametrize("name", ["dense_scoped", "structural_adjacent", "structural_bindings", "code_search_files"])
def test_sets_that_the_sql_leaves_whole_have_no_limit(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().analyzed().toString()
    assert "Limit 10000" not in plan
