"""The operators' SQL against their queries, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from glyphsieve.llm.queries import QUERIES, SQL

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in Path(TABLES).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    rows = con.sql(SQL[name])
    got = QUERIES[name](spark, TABLES).select(*rows.columns).collect()
    assert got and Counter(map(tuple, got)) == Counter(rows.fetchall())
