"""Every query against DuckDB on the same tables."""

import duckdb
import pytest

from graphloom.plans import workloads

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(workloads.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = con.sql(workloads.ORACLE_SQL[name]).df()
    found = workloads.QUERIES[name](spark, sf).toPandas()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    text = lambda f: sorted(map(tuple, f[columns].astype(object).where(f[columns].notna(), None).astype(str).values.tolist()))
    assert text(found) == text(wanted)


def test_every_query_has_sql():
    assert set(workloads.QUERIES) == set(workloads.ORACLE_SQL)
