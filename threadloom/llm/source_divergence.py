"""How the sources of each language differ: chi-square-like distances of their term frequencies, and the terms behind them.

Terms with the same sparse vector of counts by source differ in nothing but their name. The kept terms are grouped by that
vector; every pair of sources is evaluated once per distinct vector and multiplied by how many terms have it. For the ranking of
terms no more than the TOP smallest of one vector can matter, as they tie in every source, so only those are ranked."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in at least; terms ranked for each source; parts of a whole.
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Distinct vectors that one group evaluates, on average; cells (vectors times sources) that it evaluates at a time.
PART_VECTORS, CELLS = 1 << 14, 1 << 20

SUMS = "lang string, source string, item string, value long"


def terms(text: Column) -> Column:
    """The terms of a text in order, A-Z in lower case; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, sources, counts): the kept terms, each with its sparse count vector in the order of sources.

    One read of the texts: each document gives its terms, which count, and its distinct terms, which count as documents. Both are
    combined before the shuffle. A vector has one entry per source that has the term."""
    one = lambda t, n, d: F.struct(t.alias("t"), F.lit(n).alias("n"), F.lit(d).alias("d"))
    both = F.array(one(F.col("terms"), 1, 0), one(F.array_distinct("terms"), 0, 1))
    each = docs.select("lang", "source", F.explode(both).alias("x")).select("lang", "source", F.explode("x.t").alias("term"), "x.n", "x.d")
    counted = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    vector = F.array_sort(F.collect_list(F.struct("source", "n")))
    joined = counted.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), vector.alias("v")).where(F.col("d") >= least)
    return joined.select("lang", "term", "total", F.col("v.source").alias("sources"), F.col("v.n").alias("counts"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact at any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2), whole(total + 2 * kept)) + 1


def _shares(counts: np.ndarray, wholes: np.ndarray) -> np.ndarray:
    """The same as share(), by long division in three steps of a thousand, so that 64 bits hold wholes of up to 9e15."""
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, wholes)
        out = out * 1000 + digit
    return out + 1


def pair_sums(vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one part of a language's distinct vectors (sources, counts, m): for every two sources the sum of m * f, both ways.

    groups: the language's sources with their totals. A part without vectors gives zeros, so every pair is there."""
    names = groups.column("source").to_pylist()
    lang = groups.column("lang")[0].as_py()
    wholes = groups.column("total").to_numpy() + 2 * groups.column("kept").to_numpy()
    place = {s: k for k, s in enumerate(names)}
    sums = np.zeros((len(names), len(names)), np.int64)
    step = max(1, CELLS // max(1, len(names)))
    for at in range(0, vectors.num_rows, step):
        some = vectors.slice(at, step).combine_chunks()
        sources, counts = (some.column(c).combine_chunks() for c in ("sources", "counts"))
        sizes = np.diff(sources.offsets.to_numpy())
        cells = np.zeros((some.num_rows, len(names)), np.int64)
        coded = sources.flatten().dictionary_encode()
        known = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)
        cells[np.repeat(np.arange(some.num_rows), sizes), known[coded.indices.to_numpy()]] = counts.flatten().to_numpy()
        p, m = _shares(cells, wholes), some.column("m").to_numpy()
        for k in range(len(names) - 1):
            apart = p[:, k + 1 :] - p[:, k : k + 1]
            sums[k, k + 1 :] += m @ (apart * apart // (p[:, k + 1 :] + p[:, k : k + 1]))
    sums += sums.T
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    named = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": named.take(pa.array(a)), "item": named.take(pa.array(b)), "value": sums[a, b]})


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by its distance, and the top terms by which a
    source stands out from its language.

    Null texts have no terms; null languages and sources are ''. Every row is a document, repeated ones too. A source without
    terms, or of a language that keeps none, still has its pairs (0 where none is kept). Other columns are not read; an empty table
    gives no rows. The result has the square of a language's sources, and a group holds such a square of sums in memory."""
    named = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), terms(F.col(text_col)).alias("terms"))
    vectors = materialize(kept_terms(named, least))
    entries = vectors.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", F.col("total").alias("lang_count"), F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
    wholes = vectors.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    groups = named.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(wholes, "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "lang_total", "kept")]))

    distinct = materialize(vectors.groupBy("lang", "sources", "counts").agg(F.count(F.lit(1)).alias("m")))
    parts = max(1, math.ceil(distinct.count() / PART_VECTORS))
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("sources", "counts"), F.lit(parts)))
    asked = groups.select("lang", "source", "total", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    partial = dealt.groupBy("lang", "part").cogroup(asked.groupBy("lang", "part")).applyInArrow(pair_sums, SUMS)
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    alike = Window.partitionBy("lang", "sources", "counts").orderBy("term")
    few = vectors.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= top)
    few = few.select("lang", "term", F.col("total").alias("lang_count"), F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    told = few.select("lang", F.col("e.sources").alias("source"), F.col("term").alias("item"), "lang_count", F.col("e.counts").alias("n")).join(groups, ["lang", "source"])
    told = told.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))).where("p > q")
    told = told.select("lang", "source", "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    told = told.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(told).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, terms in at least 10 of a language's documents, ten terms a source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as w from documents),
g as (select distinct lang, source from d),
k as (select lang, t from (select lang, unnest(list_distinct(w)) as t from d) group by lang, t having count(*) >= {LEAST_DOCS}),
v as (select l.lang, count(k.t)::hugeint as v from (select distinct lang from g) l left join k on k.lang = l.lang group by l.lang),
c as (select x.lang, x.source, x.t, count(*)::hugeint as n from (select lang, source, unnest(w) as t from d) x join k on k.lang = x.lang and k.t = x.t group by x.lang, x.source, x.t),
totals as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
p as (
  select s.lang, s.source, k.t, coalesce(c.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) as p
  from totals s join k on k.lang = s.lang join v on v.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.t = k.t),
q as (
  select k.lang, k.t, 1 + ({SCALE}::hugeint * (sum(c.n)::hugeint + 2)) // (any_value(w.total) + 2 * any_value(v.v)) as q
  from k join c on c.lang = k.lang and c.t = k.t join v on v.lang = k.lang join (select lang, sum(total)::hugeint as total from totals group by lang) w on w.lang = k.lang
  group by k.lang, k.t),
sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
told as (
  select p.lang, p.source, 'term' as part, p.t as item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::bigint as value
  from p join q on q.lang = p.lang and q.t = p.t where p.n > 0 and p.p > q.q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from told))
select * from ranked where part = 'pair' or rank <= {TOP}
"""
