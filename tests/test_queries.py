"""Every registered query of the vector library against its DuckDB oracle."""

import duckdb
import pytest

from vecloom.plans import oracles, registry

TABLES = ("embeddings", "events", "lineitem")


def tidy(d):
    cols = sorted(d.columns)
    return d[cols].astype(str).sort_values(cols).values.tolist()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert tidy(got) == tidy(con.execute(oracles.ORACLE_SQL[name]).fetchdf())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())


def test_plans_read_only_what_they_need(spark, sf_dir):
    plan = registry.QUERIES["sign_encode"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan and "Exchange" not in plan and "Python" not in plan
