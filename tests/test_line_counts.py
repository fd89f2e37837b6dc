"""The line diff in bits, against the table of common lengths that it stands for."""

import random
import time

from pyspark.sql import functions as F

from threadloom.operators import linediff


def by_table(a, b):
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if a[i] == b[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("ctx", i + 1, j + 1, a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or common[i + 1][j] >= common[i][j + 1]):
            out.append(("del", i + 1, None, a[i]))
            i += 1
        else:
            out.append(("add", None, j + 1, b[j]))
            j += 1
    return out


def test_same_rows_and_counts():
    rng = random.Random(5)
    for _ in range(3000):
        letters = "abcdefgh"[: rng.randrange(1, 9)]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        want = by_table(a, b)
        assert linediff.diff_lines("\n".join(a), "\n".join(b)) == want
        assert linediff.changed_lines("\n".join(a), "\n".join(b)) == tuple(sum(r[0] == k for r in want) for k in ("add", "del"))


def test_counts_of_large_and_missing_texts(spark):
    big = linediff.changed_lines("\n".join(f"a{i}" for i in range(2500)), "\n".join(f"a{i}" for i in range(2400)))
    assert big == (2400, 2500)  # above the most cells nothing is in common
    rng = random.Random(6)
    a, b = ("\n".join(str(rng.randrange(500)) for _ in range(1900)) for _ in range(2))
    began = time.process_time()
    for _ in range(20):
        linediff.changed_lines(a, b)
    assert time.process_time() - began < 1  # the table took 2
    rows = spark.createDataFrame([(1, None, None), (2, "a\nb", None), (3, "a\nb\nc", "a\nx\nc")], "id int, o string, n string")
    got = rows.select("id", linediff.line_counts(F.col("o"), F.col("n")).alias("d")).select("id", "d.*").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (2, 1, 2), (3, 1, 1)]


def test_only_counts_come_back(spark, tmp_path):
    from threadloom.plans import registry

    pages = [(1, "a\nb\nc\nd\ne\nf\ng\nh\ni"), (2, None), (3, "x")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = registry.queries()["line_diff_counts"](spark, str(tmp_path))
    assert "type:string" not in df._jdf.queryExecution().executedPlan().toString() and df.schema["added"].dataType.typeName() == "integer"
    rows = registry.queries()["line_diff"](spark, str(tmp_path)).collect()
    count = lambda k, kind: sum(r["page_id"] == k and r["type"] == kind for r in rows)
    assert sorted(map(tuple, df.collect())) == [(k, count(k, "add"), count(k, "del")) for k in (1, 2, 3)]
