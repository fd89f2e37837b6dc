"""The queries: on empty tables, on odd rows, against DuckDB where SQL can express them."""

import math

import duckdb
import pytest

from threadloom.llm import queries as Q

NAMES = sorted(Q.queries())


def rows(records, columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert Q.queries()[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("where", ["odd_dir", "small_dir"])
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_oracle(spark, name, where, request):
    folder = request.getfixturevalue(where)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, want = Q.queries()[name](spark, folder), con.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)
