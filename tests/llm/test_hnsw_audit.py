"""Sparse links: the audit goes on until it has seen enough queries with links."""

import pickle

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import hnsw_dedup


def vectors(ids, x, shard):
    n = len(ids)
    return pa.table({"label": pa.array([0] * n), "dims": pa.array([x.shape[1]] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "shards": pa.array([2] * n, pa.int32()), "class_id": pa.array(ids, pa.int64()), "copies": pa.array([1] * n, pa.int64()), "vec": pa.array(list(x))})


@pytest.mark.parametrize("same_shard", [False, True])
def test_sparse_links_are_audited_beyond_the_first_queries(same_shard):
    """600 queries of which three have a link, to nodes that no search of the graph reaches: more queries than are audited
    where all have links."""
    rng = np.random.default_rng(3)
    nodes, queries = rng.normal(size=(600, 16)), rng.normal(size=(600, 16))
    assert hnsw_dedup.AUDITED < len(queries)
    twins = [(101, 207), (350, 11), (598, 402)]
    for q, n in twins:
        (nodes if same_shard else queries)[q] = nodes[n] + 0.01
    built = hnsw_dedup._built(vectors(range(600), nodes, 1))
    graph, unit, ids, copies = pickle.loads(built.column("graph")[0].as_buffer())
    lost = np.isin(ids, [i for pair in twins for i in pair])
    for layer in graph.layers:
        layer[np.isin(layer, np.flatnonzero(lost))] = -1
        layer[lost] = -1
    asked = vectors(range(600), nodes, 1) if same_shard else vectors(range(1000, 1600), queries, 0)
    got = hnsw_dedup._answer(asked.select(["class_id", "vec"]), (graph, unit, ids, copies), 0.98)
    edges = {(a, b) for a, b in zip(got.column("a").to_pylist(), got.column("b").to_pylist()) if b is not None}
    assert edges == ({tuple(sorted(p)) for p in twins} if same_shard else {(n, 1000 + q) for q, n in twins})
    assert sum(got.column("n").to_pylist()) == (6 if same_shard else 3)


def test_audit_stops_once_enough_linked_queries_were_seen():
    x = np.eye(8)[np.arange(2000) % 8]
    asked, q, i = hnsw_dedup._audit(x, np.eye(8), None, 0.98, 100)
    assert len(asked) == 256 and len(q) == len(i) == 256
    asked, q, _ = hnsw_dedup._audit(x, -np.eye(8), None, 0.98, 100)
    assert len(asked) == 2000 and len(q) == 0


def test_links_that_no_beam_reaches_are_found_by_brute_force(monkeypatch):
    """The audit sees one lost link; the others of the block must be found, too."""
    rng = np.random.default_rng(5)
    nodes, queries = rng.normal(size=(400, 16)), rng.normal(size=(900, 16))
    queries[::3] = nodes[:300] + 0.001
    graph, unit, ids, copies = pickle.loads(hnsw_dedup._built(vectors(range(400), nodes, 1)).column("graph")[0].as_buffer())
    for layer in graph.layers:
        layer[:] = -1
    asked = vectors(range(1000, 1900), queries, 0).select(["class_id", "vec"])
    got = hnsw_dedup._answer(asked, (graph, unit, ids, copies), 0.98, audited=5)
    assert sum(got.column("n").to_pylist()) == 300
    assert got.column("found_links")[got.num_rows - 1].as_py() < got.column("true_links")[got.num_rows - 1].as_py() < 300


def test_thousands_of_links_over_many_shards(spark, monkeypatch):
    """Clusters, pairs and a dense group over several labels, against all pairs; shards of few rows, graphs sent to several lanes."""
    monkeypatch.setattr(hnsw_dedup, "LANE_BLOCKS", 2)
    rng = np.random.default_rng(9)
    rows, x = [], []
    for label, (clusters, size, noise) in enumerate([(40, 12, 0.03), (300, 2, 0.02), (2, 150, 0.02), (200, 1, 0)]):
        for centre in rng.normal(size=(clusters, 24)):
            for v in centre + noise * rng.normal(size=(size, 24)):
                rows.append((len(rows), v.tolist(), label))
                x.append(v)
    x = np.asarray(x) / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.asarray([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    least = np.arange(len(rows))
    while True:
        lower = np.minimum(least, np.where(near, least[None, :], len(rows)).min(axis=1))
        if (lower == least).all():
            break
        least = lower
    assert near.sum() > 20_000
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hnsw_dedup.near_duplicates(table, shard_rows=70).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, int(near[i].sum()), int(least[i]), bool(least[i] == i)) for i in range(len(rows))}


def test_recall_is_reported(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 1, 1, 12) for i, v in enumerate(np.repeat(rng.normal(size=(60, 12)), 3, axis=0) + 0.005 * rng.normal(size=(180, 12)))]
    classes = spark.createDataFrame(rows, "class_id long, vec array<double>, label int, copies long, dims int")
    told = hnsw_dedup.recall(hnsw_dedup.searched(classes, shard_rows=50)).first()
    assert told.groups > 1 and told.audited > 0 and 0.9 * told.true_links <= told.found_links <= told.true_links


def test_vectors_of_other_lengths_are_never_compared(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (3, [1.0, 0.0, 0.0], 0), (4, [1.0, 0.001, 0.0], 0), (5, [1.0, 0.0], None), (6, [], 0), (7, [2.0, 0.0], 1)]
    got = hnsw_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)}
