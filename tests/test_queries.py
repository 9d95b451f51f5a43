"""Registered queries against their SQL twins, on the smallest tables."""

import math

import duckdb
import pytest

from marginalia.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, columns, names):
    order = [names.index(c) for c in columns]
    show = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rel = duck.sql(catalogue.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert plain([tuple(r) for r in df.collect()], columns, df.columns) == plain(rel.fetchall(), columns, rel.columns)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
