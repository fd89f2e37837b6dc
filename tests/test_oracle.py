"""Every query of the engine that has SQL, against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

from threadloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(records, columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert registry.flagship(spark, SF).count() > 0
