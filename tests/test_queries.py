"""Every query with SQL against DuckDB, as the driver does: rows, columns, values."""

import math
from collections import Counter

import duckdb
import pytest
from pathlib import Path

from objectlake.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    want = Counter(tuple(plain(row[i]) for i in at) for row in rel.fetchall())
    assert got == want
