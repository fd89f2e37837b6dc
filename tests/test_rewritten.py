"""Documents walked within their row, against the walk by levels and the putting together from nodes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import variants as V
from threadloom.plans import registry


def anything(rng, depth):
    kind = rng.randrange(9) if depth else rng.randrange(5)
    if kind < 5:
        return [None, True, rng.randrange(3), rng.choice(["", "x", "é\"\n"]), 2.5][kind]
    if kind < 7:
        return {k: anything(rng, depth - 1) for k in rng.sample(["a", "b", "1", "items", "k"], rng.randrange(5))}
    return [{"k": rng.choice([1, "1", True, None, [1]])} | ({"v": anything(rng, depth - 1)} if rng.random() < 0.5 else {}) if rng.random() < 0.8 else anything(rng, depth - 1) for _ in range(rng.randrange(5))]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(31)
    values = [anything(rng, 2) for _ in range(150)] + [[{"k": 1, "v": [{"k": 1}, {"k": 1}]}, {"k": 1}, {"k": "1"}], {}, [], [[], {}]]
    return spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(values)] + [(999, None)], "id int, j string").select("id", F.parse_json("j").alias("d")).cache()


def test_nodes_in_a_row(docs):
    # Compared as text, kind and place; a deeper document than was said is an error and no cut.
    told = lambda df: sorted(map(repr, df.select("id", "path", "depth", "parent", "name", "kind", "value", "json").collect()))
    assert told(V.nodes(docs, "d", ["id"], 6)) == told(V.nodes(docs, "d", ["id"]))
    with pytest.raises(Exception, match="deeper than was said"):
        V.nodes(docs, "d", ["id"], 1).collect()


def test_rewritten_as_rebuilt(docs):
    tree = V.nodes(docs, "d", ["id"])
    told = lambda df: {r["id"]: r["doc"] for r in df.where("id <> 999").collect()}
    new = lambda *args: told(docs.select("id", V.rewritten(F.col("d"), 6, *args).alias("doc")))
    assert new(lambda k, v: k.isin("items", "k", "b")) == told(V.rebuilt(V.projected(tree, ["items", "k", "b"]), ["id"]))
    assert new(lambda k, v: ~k.isin("a", "v")) == told(V.rebuilt(V.stripped(tree, ["a", "v"]), ["id"]))
    number = lambda v: V.let(F.to_json(v), lambda t: F.when(t == "true", "1").when(t == "false", "0").otherwise(t))
    want = V.rebuilt(V.numbers_for_booleans(V.without_null_members(tree)), ["id"], "k")
    assert new(lambda k, v: ~F.is_variant_null(v), number, "k") == told(want)
    with pytest.raises(Exception, match="deeper than was said"):
        docs.select(V.rewritten(F.col("d"), 1, lambda k, v: F.lit(True))).collect()


@pytest.mark.parametrize("name", ["projected_tree", "stripped_tree", "postprocessed_tree"])
def test_one_exchange(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Python" not in plan
