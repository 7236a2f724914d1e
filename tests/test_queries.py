"""Queries against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__
from glyphsieve.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def ordered(df):
    cols = sorted(df.columns)
    return df[cols].sort_values(cols, na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("eval_confusion", "eval_ranking", "eval_source_gap", "misclassified_topk")])
def test_same_rows(spark, sf, duck, name):
    a, b = ordered(QUERIES[name](spark, sf).toPandas()), ordered(duck.sql(SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert (a.eq(b) | (a.isna() & b.isna())).all().all()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
