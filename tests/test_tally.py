"""Nodes counted within their document, against the walk by levels and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import open_documents as O, variants as V
from threadloom.plans import registry

NUMBERS = ["0", "-0", "-7", "2.50", "100.0", "-0.0", "0.1000", "1e3", "1E22", "2.5e-7", "-1.5e8", "1e-3", "9" * 38, "1" + "0" * 38, "123456789012345678901234567890.5", "0.00"]


def anything(rng, depth):
    kind = rng.randrange(10) if depth else rng.randrange(6)
    if kind < 6:
        return [None, True, False, rng.randrange(3), rng.choice(["", "x", "é\"\n", "1", "true", "null", "\U0001f600", "￿"]), 2.5][kind]
    if kind < 8:
        return {k: anything(rng, depth - 1) for k in rng.sample(["a", "b", "1", "", "ü"], rng.randrange(5))}
    return [anything(rng, depth - 1) for _ in range(rng.randrange(5))]


def told(df):
    return sorted(map(repr, df.select("id", "depth", "name", "kind", "n", "least").collect()))


def test_tally_as_nodes_by_level(spark):
    rng = random.Random(41)
    texts = [json.dumps(anything(rng, 5), ensure_ascii=k % 2 > 0) for k in range(150)] + [f"[{x}]" for x in NUMBERS] + [f'{{"a": [{", ".join(NUMBERS)}, "1", true, false, null, {{}}, []]}}', "[" * 30 + "]" * 30]
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, j string")
    nodes = V.nodes(docs.select("id", F.parse_json("j").alias("d")), "d", ["id"])
    want = nodes.groupBy("id", "depth", "name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
    assert told(O.tallied(docs, "j", ["id"])) == told(want)


def test_keys_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, "x", "[1]"), (1, "x", "[1]"), (None, "y", "null"), (2, "z", None)], "id int, k string, j string")
    got = sorted(map(tuple, O.tallied(rows, "j", ["k", "id"]).collect()), key=repr)
    assert got == sorted([("x", 1, 0, None, "array", 1, None), ("x", 1, 1, None, "number", 1, "1")] * 2 + [("y", None, 0, None, "null", 1, None)], key=repr)
    assert O.tallied(rows.where("id = 2"), "j", ["k"]).count() == 0
    for broken in ("[NaN]", "[1", ""):
        with pytest.raises(ValueError):
            O.tally(broken)


def test_deep_and_wide_documents():
    assert O.tally("[" * 500 + "7" + "]" * 500)[-1] == (500, None, "number", 1, "7")
    assert O.tally(json.dumps([{"a": k} for k in range(20000)])) == [(0, None, "array", 1, None), (1, None, "object", 20000, None), (2, "a", "number", 20000, "0")]


def test_one_exchange_and_nothing_stored(spark):
    df = registry.queries()["document_nodes"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD" not in plan and "Union" not in plan and plan.count("Aggregate") == 1
