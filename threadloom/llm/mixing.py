"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within its source, documents are put into ranges of the key and ordered inside each
range; prefix sums of word counts add up over the ranges, and the source is cut at its exact budget, after as many
whole epochs as the budget holds. Keys are uniform, so the ranges of a hot source are as even as those of any other and no
task ever orders a whole source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD_SQL

#: Rows of a source that share a range of the key, on average, when the source holds all rows.
RANGE_ROWS = 1 << 16
WEIGHTS = (5, 2, 1)
MOST = 3


def mix_key(id_col: str = "doc_id", text_col: str = "text", seed: str = "mix-1") -> Column:
    """A hash-random key, the same on every run. The text is part of it, so that null and repeated ids do not share a range."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1") -> DataFrame:
    """(doc_id, source, size, mix_key): the words of the text (null: 0) are its size."""
    size = F.coalesce(F.expr(f"regexp_count(`{text_col}`, '{WORD_SQL}')"), F.lit(0)).cast("long")
    return docs.select(F.col(id_col), F.col(source_col).alias("source"), size.alias("size"), mix_key(id_col, text_col, seed).alias("mix_key"))


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target): the whole size shared by weight, no target above `most` times its source.

    Sharing the excess again until nothing is above its cap ends at one level: target = min(cap, level * weight). Sources are
    ordered by cap / weight; the level belongs to the first prefix of capped sources whose next source is not capped (later prefixes give lower levels). Works on
    one row per source. Weights repeat over the sources in code-point order, null last."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = source_sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    caps = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = caps.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = levels.withColumn("level", F.col("left_size").cast("double") / F.col("left_weight"))
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    return levels.withColumn("at", level).select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, ranges: int | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, **cols: str) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words taken, repeats counted).

    The budget is the target rounded to whole words: `epochs` whole passes, then documents in key order until the rest is
    spent; the document at the cut gives only its first words, so a source's taken words are its budget exactly. Documents
    without words take nothing. Null texts have size 0; a null source is a source of its own; an empty table gives no
    rows; repeated rows are separate documents; other columns are not read. ranges: by default one for each RANGE_ROWS rows of
    the table, so that no task orders more of a hot source; their number does not change the result."""
    id_col = cols.get("id_col", "doc_id")
    ranges = ranges or max(64, math.ceil(docs.count() / RANGE_ROWS))
    thin = sized(docs, **cols).withColumn("range", (F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("int"))
    thin = thin.repartition("source", "range")
    sums = thin.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goals = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most).withColumn("budget", F.round("target").cast("long"))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(over), F.lit(0))).drop("range_size")
    # Sources meet their goals here, at one row per range, so that no row of a document is dealt by source alone.
    starts = starts.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "r.range", "range_start", "source_size", "target", "budget")
    inside = Window.partitionBy("source", "range").orderBy("mix_key", id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = thin.withColumn("upto", F.sum("size").over(inside))
    placed = ordered.alias("o").join(starts.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")) & (F.col("o.range") == F.col("s.range")))
    joined = placed.select(F.col(f"o.{id_col}"), F.col("o.source").alias("source"), "size", "mix_key", (F.col("range_start") + F.col("upto") - F.col("size")).alias("before"), "source_size", "target", "budget")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    joined = joined.withColumn("epochs", epochs).withColumn("part", part)
    return joined.select(id_col, "source", "size", "mix_key", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def drawn(docs: DataFrame, text_col: str = "text", source_col: str = "source", **cols: str) -> DataFrame:
    """The rows of `docs` as the mix has them: once per epoch, and the row at a source's cut with its first words only.

    Rows with equal id, text and source are told apart by counting: of each such group, the mix says how many are taken whole
    and how many words of one more. The window that counts them and the join share one exchange of the texts."""
    pick = lambda key, source: F.md5(F.concat_ws("|", key, F.coalesce(F.concat(F.lit("of "), source), F.lit("none"))))
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part"))
    taken = mix(docs, text_col=text_col, source_col=source_col, **cols).where("taken > 0").groupBy(pick(F.col("mix_key"), F.col("source")).alias("_pick"))
    taken = taken.agg(F.max("epochs").alias("_epochs"), F.max("size").alias("_size"), F.count_if((F.col("part") > 0) & (F.col("part") == F.col("size"))).alias("_whole"), F.max(cut).alias("_cut"))
    place = F.row_number().over(Window.partitionBy("_pick").orderBy("_pick"))
    numbered = docs.withColumn("_pick", pick(mix_key(cols.get("id_col", "doc_id"), text_col), F.col(source_col))).withColumn("_place", place)
    joined = numbered.join(taken, "_pick")
    part = F.when(F.col("_place") <= F.col("_whole"), F.col("_size")).when(F.col("_place") == F.col("_whole") + 1, F.coalesce("_cut", F.lit(0))).otherwise(0)
    copies = F.when(part > 0, F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("_epochs").cast("int")), F.array(part.cast("long")))).otherwise(F.array_repeat(F.lit(None).cast("long"), F.col("_epochs").cast("int")))
    word = f"[\\\\x20\\\\x09-\\\\x0D]*{WORD_SQL}"
    first_words = F.expr(f"array_join(slice(regexp_extract_all(`{text_col}`, '{word}', 0), 1, cast(_words as int)), '')")
    each = joined.withColumn("_words", F.explode(copies))
    text = F.when(F.col("_words") < F.col("_size"), first_words).otherwise(F.col(text_col))
    return each.withColumn(text_col, text).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 5, 2, 1, 5, ..., none above 3 times its size."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat_ws('|', 'mix-1', doc_id::varchar, md5(coalesce(text, '')))) as mix_key from documents),
sums as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from sized group by source),
caps as (
  select *, case (k - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 3 as cap from sums),
ratios as (select *, cap::double / weight as ratio from caps),
levels as (
  select *, ((sum(source_size) over ())::bigint - coalesce(sum(cap) over w, 0)::bigint)::double / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from ratios window w as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
goals as (
  select source, source_size, least(cap::double, max(case when ratio >= level then level end) over () * weight) as target from levels),
placed as (
  select s.*, g.source_size, g.target, round(g.target)::bigint as budget,
    (sum(s.size) over (partition by s.source order by mix_key, doc_id, size rows between unbounded preceding and current row))::bigint - s.size as before
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
  case when source_size = 0 then 0 else (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) end::bigint as taken
from placed
"""
