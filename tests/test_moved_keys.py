"""A second version whose moved key is another field's: both fields of that key stay, as in SQL."""

import datetime

import duckdb
import pytest

from threadloom.plans import registry

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"


def line(form, key, code, width, flag="N", status="O"):
    return (form, key, 1, code, float(width), 1.0, 0.0, 0.0, flag, status, datetime.date(2024, 1, 1))


@pytest.mark.parametrize("name", ["doc_diff_by_identity", "diff_summary", "restore_untouched", "continuation_rule"])
def test_two_new_fields_of_one_key(spark, tmp_path, name):
    rows = [line(1, 5, 7, 10, "R", "F"), line(1, 1000005, 1, 20, "R"), line(2, 5, 7, 10), line(2, 1000005, 4, 20), line(3, 5, 7, 10, "N", "F"), line(3, 1000005, 7, 10, "N", "F"), line(4, 5, 7, 20), line(4, 1000005, 1, 20), line(4, 7, 4, 1)]
    spark.createDataFrame(rows, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))
