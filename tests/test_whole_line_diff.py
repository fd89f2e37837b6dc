"""The line diff of texts of any size: one rule, whatever the size."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_line_counts import by_table

from threadloom.operators import linediff
from threadloom.plans import registry


@pytest.mark.parametrize("held", [0, 9, 40])
def test_rows_made_again_in_blocks(monkeypatch, held):
    monkeypatch.setattr(linediff, "HELD_BITS", held)
    rng = random.Random(held)
    for _ in range(1500):
        letters = "abcdefgh"[: rng.randrange(1, 9)]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(1, 24))] for _ in range(2))
        want = by_table(a, b)
        assert linediff.diff_lines("\n".join(a), "\n".join(b), None) == want
        assert linediff.changed_lines("\n".join(a), "\n".join(b), None) == tuple(sum(r[0] == k for r in want) for k in ("add", "del"))


def test_large_pages_by_the_same_rule(spark, tmp_path):
    sizes = {1: 2000, 2: 2400, 3: 30000}  # 2: more than 4,000,000 cells
    texts = [(k, "\n".join(f"line {i}" for i in range(n))) for k, n in sizes.items()]
    spark.createDataFrame(texts, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    left = {k: [i for i in range(n) if i % 7 != 3] for k, n in sizes.items()}
    altered = {k: len(range(2, len(x), 5)) for k, x in left.items()}
    want = sorted((k, altered[k], n - len(left[k]) + altered[k]) for k, n in sizes.items())
    assert sorted(map(tuple, registry.queries()["line_diff_counts"](spark, str(tmp_path)).collect())) == want
    rows = registry.queries()["line_diff"](spark, str(tmp_path)).groupBy("page_id").agg(*[F.count(F.when(F.col("type") == t, 1)) for t in ("add", "del")])
    assert sorted(map(tuple, rows.collect())) == want


def test_large_document_as_its_sql(spark, tmp_path):
    """A form of so many fields that both texts have over 2000 lines."""
    duckdb.sql(f"copy (select * replace (l_orderkey % 3 as l_orderkey, row_number() over () as l_partkey) from '/root/testdata/sf0.001/lineitem.parquet') to '{tmp_path}/lineitem.parquet' (format parquet)")
    name = "document_view_diff"
    with duckdb.connect() as duck:
        duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
        want = sorted(duck.sql(registry.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())) == want and max(r[1] for r in want) < 3
