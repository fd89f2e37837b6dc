"""Exact top-k search by inner product, in three phases with a uniform threshold.

A vector's score is the sum of its scores on SEGMENTS groups of dimensions; every block of candidates holds one score list per
segment. Phase 1: each block takes the k best of each of its lists, resolves the totals of these few entries alone, and sends the
best k of them. The k-th best that all blocks sent is a safe cutoff: so many entries reach it, and no answer scores less. Phase 2:
the cutoff goes back to the blocks; an answer needs at least cutoff / SEGMENTS, the uniform threshold, in one of its lists, so
each list gives the entries that have it. Phase 3: an entry's lists that did not give it hold less than the threshold, which
bounds its total; the entries that can still reach the cutoff have their missing scores looked up, and what reaches it is
collected. Queries and candidates meet in bounded blocks; nothing is broadcast or gathered on the driver but two counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import give_back

K = 20
SEGMENTS = 2
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 4096
#: Integers up to this size are exact in double precision.
EXACT = float(2**53)


def quantized(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): floor(scale * x) per component, as doubles holding integers; vectors null or with null or non-finite
    components are left out, as are rows without an id."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("vec"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where they are exact, else with Python integers held to the range of a long."""
    if a.shape[1] == 0 or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return a @ b.T
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, -(2**63), 2**63 - 1)


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    give_back()
    width = int(group["vec"].map(len).max())
    q, c = group[group["is_query"]], group[~group["is_query"]].sort_values("vec_id", kind="stable")
    return q["vec_id"].to_numpy(), _matrix(q["vec"], width), q["cutoff"].to_numpy(), c["vec_id"].to_numpy(), _matrix(c["vec"], width)


def _chunks(n: int, size: int = 256):
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one row, ties to the lower position (candidates are in order of id)."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > edge)
        at = np.concatenate([at, np.flatnonzero(scores == edge)[: k - len(at)]])
    else:
        at = np.arange(len(scores))
    return at


def _lists(q: np.ndarray, c: np.ndarray, segments: int) -> list[np.ndarray]:
    """The score lists of a block: one table (query, candidate) per segment."""
    edges = np.linspace(0, q.shape[1], segments + 1).astype(int)
    return [_products(q[:, a:b], c[:, a:b]) for a, b in zip(edges, edges[1:])]


def _phase_one(k: int, segments: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        qid, q, _, cid, c = _sides(group)
        out = []
        if len(qid) and len(cid):
            for part in _chunks(len(qid)):
                lists = _lists(q[part], c, segments)
                for n, i in enumerate(qid[part]):
                    others = np.flatnonzero(cid != i)
                    seen = np.unique(np.concatenate([others[_best(segment[n][others], k)] for segment in lists]))
                    total = sum(segment[n][seen] for segment in lists)
                    out.append((i, [int(x) for x in sorted(total[_best(total, k)], reverse=True)]))
        return pd.DataFrame(out, columns=["query_id", "scores"])

    return run


def reaching(rows: list[np.ndarray], cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one query's lists: (positions, totals) of all entries whose total is at least `cut`.

    Each list gives its entries at the threshold cut / len(rows) or above; the total of an entry is at most what was given plus
    less than a threshold for each list that did not give it. Totals are resolved for entries that this bound lets through."""
    m = len(rows)
    given = np.stack([row * m >= cut for row in rows])
    at = np.flatnonzero(given.any(axis=0))
    known = sum(np.where(g[at], row[at], 0) for g, row in zip(given, rows))
    missing = m - given[:, at].sum(axis=0)
    at = at[(known * m + missing * cut > cut * m) | (missing == 0)] if m > 1 else at
    total = sum(row[at] for row in rows)
    return at[total >= cut], total[total >= cut]


def _phase_two(k: int, segments: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        qid, q, cutoff, cid, c = _sides(group)
        out: list[tuple] = []
        if len(qid) and len(cid):
            for part in _chunks(len(qid)):
                lists = _lists(q[part], c, segments)
                for n, (i, cut) in enumerate(zip(qid[part], cutoff[part])):
                    at, total = reaching([segment[n] for segment in lists], int(cut))
                    at, total = at[cid[at] != i], total[cid[at] != i]
                    out += [(i, cid[at[j]], int(total[j])) for j in _best(total, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, segments: int = SEGMENTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score. Both inputs as `quantized` returns them.

    A query's own id is no candidate of it. Ties go to the smaller vec_id. A query id that repeats is asked once, with its
    smallest vector; repeated candidates count each. Shorter vectors are padded with zeros. Scores beyond a long are held at
    its limits. No queries or no candidates: no rows."""
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n_c = max(1, math.ceil(vectors.count() / candidate_block))
    n_q = max(1, math.ceil(queries.count() / query_block))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    deal = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_c)).cast("int")
    candidates = vectors.select(F.lit(False).alias("is_query"), "vec_id", "vec", F.lit(None).cast("long").alias("cutoff"), deal.alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))

    def asked(q: DataFrame) -> DataFrame:
        return q.select(F.lit(True).alias("is_query"), "vec_id", "vec", "cutoff", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), block(n_q, 1).alias("qb")).unionByName(candidates)

    lists = asked(queries.withColumn("cutoff", F.lit(None).cast("long"))).groupBy("qb", "cb").applyInPandas(_phase_one(k, segments), "query_id long, scores array<long>")
    # Two steps, so that no group holds more than k scores of each of 64 blocks at once.
    merged = lambda df, *by: df.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("scores")), False), 1, k).alias("scores"))
    lists = merged(merged(lists.withColumn("part", F.pmod(F.xxhash64("scores"), F.lit(math.ceil(n_c / 64)))), "query_id", "part"), "query_id")
    lowest = F.lit(-(2**63)).cast("long")
    cutoffs = lists.select(F.col("query_id").alias("vec_id"), F.when(F.size("scores") >= k, F.element_at("scores", k)).otherwise(lowest).alias("cutoff"))
    found = asked(queries.join(cutoffs, "vec_id")).groupBy("qb", "cb").applyInPandas(_phase_two(k, segments), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as vec from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.vec, c.vec)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
