"""Every registered query that has SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from quillmap import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(row[i] for i in at) for row in relation.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).columns


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
