"""Components with hubs: the result, and that Spark splits a hub's edges; a component and a class that hold most vectors."""

import random
from collections import Counter

import pytest

from threadloom.llm import common, hnsw_dedup

SMALL = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}


@pytest.fixture()
def small_parts(spark):
    was = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("key, how", [("lo", "left"), ("hi", "inner")])
def test_edges_of_a_hub_are_split(spark, small_parts, key, how):
    other = "hi" if key == "lo" else "lo"
    edges = common.materialize(spark.range(1, 100_000).selectExpr(f"cast(0 as long) as {key}", f"id as {other}").unionByName(spark.range(1, 500).selectExpr(f"id as {key}", f"id + 1000000 as {other}")))
    least = common.materialize(edges.groupBy("hi").agg({"lo": "min"}).withColumnRenamed("min(lo)", "top"))
    joined = common.beside(edges, key, least, how)
    assert len(joined.collect()) >= 100_000 - 1
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_components_of_stars_chains_and_cliques(spark, small_parts):
    rng = random.Random(31)
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 9999) for k in range(2000)] + [(20_000 + k, 20_001 + k) for k in range(60)] + [(30_000 + a, 30_000 + b) for a in range(20) for b in range(a)]
    edges += [(7, 7), (None, 3), (3, None), (40_001, 40_000), (40_000, 40_001)]
    edges += [(50_000 + rng.randrange(200), 50_000 + rng.randrange(200)) for _ in range(100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    rng.shuffle(edges)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter((x, find(x)) for x in list(parent))


def test_one_class_and_one_component_of_most_vectors(spark, small_parts):
    rng = random.Random(32)
    near = [[1.0, 0.001 * k, 0.0] for k in range(40)]
    rows = [(k, near[0], 1) for k in range(4000)] + [(4000 + k, near[k % 40], 1) for k in range(2000)] + [(7000 + k, None, 1) for k in range(1000)] + [(8000 + k, [rng.gauss(0, 1) for _ in range(3)], 2) for k in range(30)]
    got = {r["vec_id"]: r for r in hnsw_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["component_id"] == 0 and got[k]["n_links"] == 5999 for k in range(6000))
    assert all((got[k]["component_id"], got[k]["n_links"], got[k]["kept"]) == (k, 0, True) for k in range(7000, 8000))
