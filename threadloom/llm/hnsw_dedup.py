"""Embedding near-dedup with hierarchical navigable small-world graphs.

Equal vectors of a label are one class. The classes of a label are dealt by hash into shards of bounded size; each shard builds
a graph, and every class queries every shard of its label, in blocks that stream past the graph. A query walks down the layers, searches the base layer with
a beam, then keeps expanding whatever is within reach of the threshold. Beams widen until audited queries find all that brute
force finds in the shard; queries are audited until enough of them had links, so where links are sparse all are. Found pairs are verified by cosine in double precision, counted, and united into components."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import connected_components, give_back, look_up, materialize
from .simhash import _forest

THRESHOLD = 0.98
SHARD_ROWS = 8192
#: Links per node above and on the base layer, beam while building, first beam of a query, queries with links audited per group.
LINKS, BASE_LINKS, BUILD_BEAM, BEAM, AUDITED = 12, 24, 32, 32, 256
#: How far below the threshold a node may be and still be expanded, at first.
SLACK = 0.03
_WIDE = 4
#: Blocks of queries for which a graph travels once.
LANE_BLOCKS = 64


class Graph:
    """A small-world graph over unit vectors, built and searched many points at a time."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        heights = np.minimum(8, -np.log(np.random.default_rng(n).random(n) + 1e-12) / math.log(LINKS)).astype(int)
        heights[:1] = heights.max(initial=0)
        self.heights = heights
        self.layers = [np.full((n, BASE_LINKS if k == 0 else LINKS), -1, np.int32) for k in range(heights.max(initial=0) + 1)]
        done = 0
        while done < n:
            size = min(n - done, max(64, min(done, 1024)))
            self._insert(np.arange(done, done + size), done)
            done += size
        self._reachable()

    def _reachable(self, least: int = 4) -> None:
        """Pruning in a dense group can leave a node that no other points to: such nodes get back-links from their neighbours."""
        base = self.layers[0]
        incoming = np.bincount(base[base >= 0], minlength=len(base))
        poor = np.flatnonzero(incoming < least)
        degree = np.maximum((base[poor] >= 0).sum(axis=1), 1)
        target = np.stack([base[poor, (poor + j) % degree] for j in range(least)], axis=1).ravel()
        source = np.repeat(poor, least)[target >= 0]
        pairs = np.unique(np.stack([target[target >= 0], source], axis=1), axis=0)
        if len(pairs):
            nodes, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
            extra = np.full((len(base), count.max()), -1, np.int32)
            extra[pairs[:, 0], np.arange(len(pairs)) - np.repeat(first, count)] = pairs[:, 1]
            self.layers[0] = np.concatenate([base, extra], axis=1)

    def _insert(self, new: np.ndarray, done: int) -> None:
        near = self.x[new] @ self.x[new].T
        np.fill_diagonal(near, -2)
        entry = np.zeros((len(new), 1), np.int32)
        for level in range(len(self.layers) - 1, -1, -1):
            here = self.heights[new] >= level
            ids, sims = self.search(self.x[new], entry, level, BUILD_BEAM if here.any() else 1) if done else (np.zeros((len(new), 0), np.int32), np.zeros((len(new), 0), np.float32))
            if done:
                entry = ids[:, :4]
            if here.any():
                peers = np.where(here[None, :], near, -2.0)
                k = min(BUILD_BEAM // 2, len(new))
                top = np.argpartition(-peers, k - 1, axis=1)[:, :k]
                peer_sims = np.take_along_axis(peers, top, axis=1)
                cand = np.concatenate([ids, np.where(peer_sims > -2, new[top], -1)], axis=1)[here]
                value = np.concatenate([sims, peer_sims], axis=1)[here]
                own = new[here]
                self.layers[level][own] = self._select(cand, value, self.layers[level].shape[1])
                self._link_back(level, own)

    def _select(self, cand: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
        """For each row, the candidates nearer to it than to any taken before, then the nearest others; -1 fills up."""
        value = np.where(cand < 0, -3.0, value)
        turn = np.argsort(-value, axis=1, kind="stable")
        cand, value = np.take_along_axis(cand, turn, axis=1), np.take_along_axis(value, turn, axis=1)
        out = np.full((len(cand), most), -1, np.int32)
        for lo in range(0, len(cand), 512):
            c, v = cand[lo : lo + 512], value[lo : lo + 512]
            p = self.x[np.maximum(c, 0)]
            between = p @ p.transpose(0, 2, 1)
            taken = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                close = (taken[:, :j] & (between[:, j, :j] > v[:, j, None])).any(axis=1)
                taken[:, j] = ~close & (v[:, j] > -2.5) & (taken[:, :j].sum(axis=1) < most)
            rank = np.argsort(np.where(taken, 0, 1) + np.where(v > -2.5, 0, 2), axis=1, kind="stable")[:, :most]
            best = np.take_along_axis(np.where(v > -2.5, c, -1), rank, axis=1)
            out[lo : lo + 512, : best.shape[1]] = best
        return out

    def _link_back(self, level: int, own: np.ndarray) -> None:
        table = self.layers[level]
        source = np.repeat(own, table.shape[1])
        target = table[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        turn = np.lexsort((-sims, target))
        source, target = source[turn], target[turn]
        nodes, first = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.concatenate([first, [len(target)]])))
        extra = np.full((len(nodes), table.shape[1]), -1, np.int32)
        fits = place < table.shape[1]
        extra[np.searchsorted(nodes, target[fits]), place[fits]] = source[fits]
        cand = np.concatenate([table[nodes], extra], axis=1)
        value = np.einsum("ik,ijk->ij", self.x[nodes], self.x[np.maximum(cand, 0)])
        twice = (extra[:, :, None] == table[nodes][:, None, :]).any(axis=2)
        cand[:, table.shape[1] :][twice] = -1
        table[nodes] = self._select(cand, value, table.shape[1])

    def _fresh(self, q: np.ndarray, ids: np.ndarray, seen: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (query, node) pairs not seen before, each once; marks them."""
        ok = ids >= 0
        q, ids = q[ok], ids[ok]
        ok = ~seen[q, ids]
        q, ids = q[ok], ids[ok]
        stamp[q, ids] = np.arange(len(q))
        ok = stamp[q, ids] == np.arange(len(q))
        q, ids = q[ok], ids[ok]
        seen[q, ids] = True
        return q, ids

    def search(self, queries: np.ndarray, entry: np.ndarray, level: int, beam: int, reach: float | None = None) -> tuple:
        """The beam's (ids, similarities), best first; with `reach`, all pairs (query, id) seen at that similarity or more."""
        parts = [self._search(queries[i : i + 256], entry[i : i + 256], level, beam, reach) for i in range(0, len(queries), 256)]
        if reach is None:
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return np.concatenate([p[0] + 256 * k for k, p in enumerate(parts)]), np.concatenate([p[1] for p in parts])

    def _search(self, queries: np.ndarray, entry: np.ndarray, level: int, beam: int, reach: float | None) -> tuple:
        n, table = len(queries), self.layers[level]
        seen, stamp = np.zeros((n, len(self.x)), bool), np.zeros((n, len(self.x)), np.int32)
        ids, sims = np.full((n, beam), -1, np.int32), np.full((n, beam), -2.0, np.float32)
        open_ = np.zeros((n, beam), bool)
        found_q, found_id, found_sim, expanded = [], [], [], []
        row = np.arange(n)

        def visit(q: np.ndarray, new: np.ndarray) -> None:
            nonlocal ids, sims, open_
            q, new = self._fresh(q, new, seen, stamp)
            s = np.einsum("ij,ij->i", queries[q], self.x[new])
            if reach is not None:
                good = s >= reach
                found_q.append(q[good])
                found_id.append(new[good])
                found_sim.append(s[good])
            turn = np.argsort(q, kind="stable")
            q, new, s = q[turn], new[turn], s[turn]
            first = np.searchsorted(q, row)
            width = int(np.diff(np.concatenate([first, [len(q)]])).max(initial=0))
            if not width:
                return
            more, value = np.full((n, width), -1, np.int32), np.full((n, width), -2.0, np.float32)
            place = np.arange(len(q)) - first[q]
            more[q, place], value[q, place] = new, s
            ids, sims, open_ = (np.concatenate(v, axis=1) for v in ((ids, more), (sims, value), (open_, more >= 0)))
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, open_ = (np.take_along_axis(v, best, axis=1) for v in (ids, sims, open_))

        visit(np.repeat(row, entry.shape[1]), entry.ravel())
        while open_.any():
            best = np.argsort(np.where(open_, -sims, 3.0), axis=1, kind="stable")[:, :_WIDE]
            chosen = np.where(np.take_along_axis(open_, best, axis=1), np.take_along_axis(ids, best, axis=1), -1)
            np.put_along_axis(open_, best, False, axis=1)
            if reach is not None:
                expanded.append((np.repeat(row, best.shape[1]), chosen.ravel()))
            nearby = np.where(chosen[:, :, None] >= 0, table[np.maximum(chosen, 0)], -1).reshape(n, -1)
            visit(np.repeat(row, nearby.shape[1]), nearby.ravel())
        if reach is None:
            return ids, sims
        # Whatever is in reach and was pushed out of the beam is expanded, too, until nothing new is in reach.
        done = np.zeros_like(seen)
        for q, i in expanded:
            done[q[i >= 0], i[i >= 0]] = True
        q, i = np.concatenate(found_q), np.concatenate(found_id)
        all_q, all_i = [q], [i]
        while len(q):
            todo = ~done[q, i]
            q, i = q[todo], i[todo]
            done[q, i] = True
            next_q, next_i = [], []
            for k in range(0, len(q), 4096):
                nearby = table[i[k : k + 4096]]
                fq, fi = self._fresh(np.repeat(q[k : k + 4096], nearby.shape[1]), nearby.ravel(), seen, stamp)
                good = np.einsum("ij,ij->i", queries[fq], self.x[fi]) >= reach
                next_q.append(fq[good])
                next_i.append(fi[good])
            q, i = (np.concatenate(v) if v else np.zeros(0, int) for v in (next_q, next_i))
            all_q.append(q)
            all_i.append(i)
        return np.concatenate(all_q), np.concatenate(all_i)

    def within(self, queries: np.ndarray, own: np.ndarray | None, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs at `reach` or nearer that the search finds; `own`: the queries' own nodes, if they have any."""
        q = queries.astype(np.float32)
        entry = np.zeros((len(q), 1), np.int32)
        if own is None:
            for level in range(len(self.layers) - 1, 0, -1):
                entry = self.search(q, entry, level, 4)[0]
        else:
            entry = np.concatenate([own[:, None].astype(np.int32), entry], axis=1)
        return self.search(q, entry, 0, beam, reach)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    x = rows.values.to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)  # huge components must not overflow when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _built(group: pa.Table) -> pa.Table:
    give_back()
    group = group.sort_by("class_id")
    unit = _unit(group.column("vec"))
    rng = np.random.default_rng(0).permutation(len(unit))
    ids, copies = group.column("class_id").to_numpy()[rng], group.column("copies").to_numpy()[rng]
    graph = Graph(unit[rng])
    blob = pickle.dumps((graph, unit[rng], ids, copies), protocol=5)
    keys = [group.column(c).slice(0, 1).combine_chunks() for c in ("label", "dims", "shard", "shards")]
    return pa.table([*keys, pa.array([blob], pa.large_binary()).cast(pa.binary())], names=["label", "dims", "shard", "shards", "graph"])


def _audit(x: np.ndarray, unit: np.ndarray, own: np.ndarray | None, threshold: float, audited: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brute force over queries in random order until `audited` of them had a link, else over all of them: the queries asked, and
    the (query, node) pairs they should find, their own nodes among them."""
    turn = np.random.default_rng(len(x)).permutation(len(x))
    found_q, found_i, linked, done = [], [], 0, 0
    while done < len(x) and linked < audited:
        part = turn[done : done + 256]
        q, i = np.nonzero(x[part] @ unit.T >= threshold)
        q = part[q]
        found_q.append(q)
        found_i.append(i)
        linked += len(np.unique(q if own is None else q[own[q] != i]))
        done += len(part)
    return turn[:done], np.concatenate(found_q), np.concatenate(found_i)


ANSWER = "a long, b long, n long, audited long, true_links long, found_links long, beam int"


def _answer(queries: pa.Table, loaded: tuple, threshold: float, audited: int = AUDITED) -> pa.RecordBatch:
    """One block of queries against one shard: a row (a, n) per query with its number of links, rows (a, b) for a forest of the
    links, and a row without a or b that says what the audit saw at first: queries asked, their links, those that were found."""
    graph, unit, ids, copies = loaded
    mine, x = queries.column("class_id").to_numpy(), _unit(queries.column("vec"))
    turn = np.argsort(ids)
    own = turn[np.minimum(np.searchsorted(ids, mine, sorter=turn), len(ids) - 1)]
    own = own if (ids[own] == mine).all() else None
    audit, true_q, true_i = _audit(x, unit, own, threshold, audited)
    truth = true_q * len(ids) + true_i
    beam, slack, first = BEAM, SLACK, None
    while True:
        q, i = graph.within(x, own, beam, threshold - slack)
        pairs = q * len(ids) + i
        if own is not None:  # within a shard, a link found from either end counts for both
            back = np.full(len(ids), -1)
            back[own] = np.arange(len(mine))
            pairs = np.concatenate([pairs, back[i] * len(ids) + own[q]])
        pairs = np.unique(pairs)
        q, i = pairs // len(ids), pairs % len(ids)
        cosine = np.concatenate([np.einsum("ij,ij->i", x[q[k : k + 65536]], unit[i[k : k + 65536]]) for k in range(0, len(q), 65536)] or [np.zeros(0)])
        q, i, pairs = q[cosine >= threshold], i[cosine >= threshold], pairs[cosine >= threshold]
        there = np.isin(truth, pairs)
        first = int(there.sum()) if first is None else first
        if there.all():
            break
        if beam >= len(ids):  # no beam is wider: every query is asked by brute force
            found = [np.nonzero(x[k : k + 256] @ unit.T >= threshold) for k in range(0, len(x), 256)]
            q, i = np.concatenate([f[0] + 256 * k for k, f in enumerate(found)]), np.concatenate([f[1] for f in found])
            break
        beam, slack = 2 * beam, 2 * slack
    other = ids[i] != mine[q]
    q, i = q[other], i[other]
    n = np.bincount(q, weights=copies[i], minlength=len(mine)).astype(np.int64)
    a, b = np.minimum(mine[q], ids[i]), np.maximum(mine[q], ids[i])
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    edges = _forest(pairs[:, 0], pairs[:, 1], {})
    rows = len(mine) + len(edges)
    told = lambda v, kind: pa.array([None] * rows + [v], kind)
    columns = [pa.array([*mine.tolist(), *(e[0] for e in edges), None], pa.int64()), pa.array([None] * len(mine) + [e[1] for e in edges] + [None], pa.int64()), pa.array([*n.tolist(), *[0] * (len(edges) + 1)], pa.int64())]
    columns += [told(v, k) for v, k in ((len(audit), pa.int64()), (len(truth), pa.int64()), (first, pa.int64()), (beam, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ANSWER.split(", ")])


def _searched(threshold: float, audited: int):
    """Rows in order of shard and block: a shard's graph comes first and is held, then its queries, one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        loaded, held, at = None, [], None
        for batch in batches:
            runs, blocks = batch.column("run").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((runs[1:] != runs[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(runs)]):
                if low == high:
                    continue
                if (runs[low], blocks[low]) != at:
                    if held:
                        yield _answer(pa.Table.from_batches(held), loaded, threshold, audited)
                    held, at = [], (runs[low], blocks[low])
                if blocks[low] < 0:
                    loaded = pickle.loads(batch.column("graph")[low].as_buffer())
                else:
                    held.append(batch.slice(low, high - low).select(["class_id", "vec"]))
        if held:
            yield _answer(pa.Table.from_batches(held), loaded, threshold, audited)

    return run


def searched(classes: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, audited: int = AUDITED) -> DataFrame:
    """What every block of classes found in every shard of its label, as ANSWER says. classes: label, dims, class_id, copies, vec.

    A shard's graph travels once for every LANE_BLOCKS blocks that ask it; the blocks are streamed past it."""
    kind = dict(classes.dtypes)["label"]
    counts = classes.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(counts, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("class_id", F.lit(7)), "shards").cast("int"))
    graphs = dealt.select("label", "dims", "shard", "shards", "class_id", "copies", "vec").groupBy("label", "dims", "shard").applyInArrow(_built, f"label {kind}, dims int, shard int, shards int, graph binary")
    lanes = F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / LANE_BLOCKS).cast("int")))
    lane = F.floor(F.col("block") / LANE_BLOCKS).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    none = lambda t: F.lit(None).cast(t)
    right = graphs.select("label", "dims", "shard", lanes.alias("lane"), F.lit(-1).alias("block"), none("long").alias("class_id"), none("array<double>").alias("vec"), "graph")
    left = dealt.select("label", "dims", F.col("shard").alias("block"), "class_id", "vec", every.alias("shard")).select("label", "dims", "shard", lane.alias("lane"), "block", "class_id", "vec", none("binary").alias("graph"))
    keys = ["label", "dims", "shard", "lane"]
    rows = right.unionByName(left).repartition(*keys).sortWithinPartitions(*keys, "block")
    return rows.select(F.xxhash64(*keys).alias("run"), "block", "class_id", "vec", "graph").mapInArrow(_searched(threshold, audited), ANSWER)


def recall(found: DataFrame) -> DataFrame:
    """One row: blocks searched, queries audited, their links, how many of these the first beam had found, the widest beam."""
    told = found.where("a is null and b is null")
    return told.agg(F.count(F.lit(1)).alias("groups"), F.sum("audited").alias("audited"), F.sum("true_links").alias("true_links"), F.sum("found_links").alias("found_links"), F.max("beam").alias("widest_beam"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", audited: int = AUDITED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label and one length are compared. Vectors without a label, null, empty or zero vectors and vectors with
    null or non-finite components link with nothing: they are their own component. Equal vectors are one class, so a class of
    copies costs one search; rows that repeat an id count as separate vectors. A null id is never a component's name while
    the component has another. An empty table gives no rows; other columns are not read."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(~bad & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull(), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(sound, v).alias("vec"))
    usable = base.where(F.col("vec").isNotNull())
    classes = usable.groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # A class is named by a hash of its content, which stays the same when a task runs again; ids may be null or repeat.
    classes = materialize(classes.withColumn("class_id", F.xxhash64("label", "vec")).withColumn("dims", F.size("vec")))
    found = materialize(searched(classes, threshold, shard_rows, audited))
    linked = found.where("a is not null and b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    joined = classes.select("class_id", "first_id", "copies").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").join(linked, "class_id")
    joined = materialize(joined.select("class_id", "first_id", "copies", (F.col("copies") - 1 + F.col("others")).cast("long").alias("n_links"), F.coalesce("component", "class_id").alias("component")))
    # A component may hold most classes, a class most vectors: both are looked up, not dealt by their name.
    smallest = materialize(joined.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = materialize(look_up(joined, smallest, "component", "members").select("class_id", "component_id", "n_links", "copies"))
    found = look_up(usable.select("vec_id", F.xxhash64("label", "vec").alias("class_id")), named, "class_id", "copies").select("vec_id", "n_links", "component_id")
    single = base.where(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine of 0.98 or more within a label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
parts as (select a, min(b) as low from reach group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(counts.n, 0)::bigint as n_links, least(e.vec_id, coalesce(low, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) as kept
from embeddings e left join parts on parts.a = e.vec_id left join counts on counts.a = e.vec_id
"""
