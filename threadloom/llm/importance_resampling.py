"""Resampling documents by importance for a target: hashed word features, array-scored weights, Gumbel keys, distributed radix selection.

Features are hashed into a fixed number of buckets; how much likelier a bucket is in the target than in the documents is one
number, so all gains are one array of that fixed length, and a document's weight is the mean of the gains of its features. The
scores are weights with Gumbel noise, whose largest are a draw without replacement. The exact last key that is drawn is found
digit by digit: each pass counts the candidates by the next digit and keeps the digit in which the wanted rank lies. Only the
rows up to that key are sorted by range and ranked; no other row moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bits of a key that one pass of the selection looks at: the driver gets at most 2 ** DIGIT counts.
DIGIT = 16


def words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(own: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one space, repeats included."""

    def runs(k: int) -> Column:
        starts = F.when(F.size(own) >= k, F.sequence(F.lit(1), F.size(own) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice(own, at, k), " "))

    return F.concat(own, *map(runs, range(2, longest + 1))) if longest > 1 else own


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    """The unsigned CRC-32 of the feature's UTF-8 bytes, modulo the number of buckets."""
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket, counted before the shuffle; at most `buckets` rows."""
    each = texts.select(words(F.col(text_col)).alias("words")).select(F.explode(features(F.col("words"), longest)).alias("feature"))
    return each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_col: str = "text", target_col: str = "text") -> list[int]:
    """For each bucket, floor(1000 * ln of how much likelier it is in the target), one added to every bucket's counts.

    The driver gets `buckets` numbers, whatever the size of the tables."""
    ours = bucket_counts(docs, buckets, longest, text_col).withColumnRenamed("n", "s")
    theirs = bucket_counts(target, buckets, longest, target_col).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(ours, "bucket", "left").join(theirs, "bucket", "left")
    found = {r["bucket"]: (r["s"], r["t"]) for r in both.na.fill(0, ["s", "t"]).select("bucket", "s", "t").collect()}
    all_s, all_t = (sum(x[k] for x in found.values()) for k in (0, 1))
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    rows = docs.sparkSession.createDataFrame([(b, s, t) for b, (s, t) in found.items()], "bucket int, s long, t long")
    gained = {r["bucket"]: r["gain"] for r in rows.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()}
    return [gained[b] for b in range(buckets)]


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(1000 times a Gumbel number) that the seed and the id decide (a null id: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row. A document without features has weight 0."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # a constant, folded once
    own = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    own = own.select("doc_id", F.size("words").cast("long").alias("n_words"), features(F.col("words"), longest).alias("features"))
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + F.get(table, bucket(f, len(gain))))
    own = own.select("doc_id", "n_words", F.size("features").cast("long").alias("n_features"), total.alias("total"))
    # Integer division goes toward zero; the floor is one less where a negative sum leaves a rest.
    whole = F.when(F.col("n_features") > 0, F.call_function("div", F.col("total") - F.pmod("total", "n_features"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    return own.withColumn("weight", whole).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("total")


def last_drawn(rows: DataFrame, n: int, keys: list[str]) -> list[int] | None:
    """The first components of the n-th smallest key, as many as decide: rows whose components are smaller or equal are the n smallest.

    rows: materialized, with not-null long columns `keys`, of which the last is unique. Each component is looked through from the
    highest bit in which candidates differ, DIGIT bits a pass; a pass is one aggregate and ends with at most 2 ** DIGIT counts on
    the driver. None if there are no more than n rows, so that all are drawn."""
    if rows.count() <= n:
        return None
    left, found, unsigned = n, [], lambda v: (v ^ (1 << 63)) % (1 << 64)
    for key in keys:
        # Two's complement with the sign flipped: bits in the order of the numbers.
        bits = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
        low, high, count = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        shift = (unsigned(low) ^ unsigned(high)).bit_length()
        while shift and count > left:
            step = min(DIGIT, shift)
            shift -= step
            digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << step) - 1))
            for value, count in sorted(map(tuple, rows.groupBy(digit.alias("digit")).count().collect())):
                if count >= left:
                    break
                left -= count
            rows = rows.where(digit == value)
        found.append(rows.agg(F.max(key)).first()[0])
        if count == left:
            break
    return found


def up_to(keys: list[str], last: list[int]) -> Column:
    """Whether a row's components come before the given ones or are equal to them."""
    inside = F.lit(True)
    for key, value in reversed(list(zip(keys, last))):
        inside = (F.col(key) < value) | ((F.col(key) == value) & inside)
    return inside


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with their place (rank, from 1) in the order of the keys, which are unique.

    Sorted by range and stored; a row's place is that in its range and the rows of the ranges before it."""
    stored = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))
    # The id that Spark gives to rows of stored partitions: the partition above 33 bits of place in it.
    at = stored.withColumn("_at", F.monotonically_increasing_id())
    placed = at.withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    held = sorted(map(tuple, placed.groupBy("_range").count().collect()))  # a row for each partition
    starts, before = [], 0
    for part, n in held:
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_range long, _before long")
    return placed.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_at", "_range", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every row with doc_id, n_words, n_features, weight, score and, if drawn, its rank (else null).

    Of the rows with at least `least_words` words, that percentage (rounded down) with the highest scores is drawn. Ties go to the
    smaller id, rows without an id last; rows of one id and score to fewer features, then to their place in the input. Repeated
    rows are separate. Null texts have no words and are never drawn; null target texts count nothing; an empty target, which is
    then as likely everywhere, is allowed; an empty table gives no rows. Other columns are not read."""
    keys = ["_down", "_no_id", "_id", "n_features", "_copy"]
    rows = scored(docs, gains(docs, target, buckets, longest, text_col, target_col), longest, seed, id_col, text_col)
    rows = rows.withColumn("_down", -F.col("score")).withColumn("_no_id", F.col("doc_id").isNull().cast("long")).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_copy", F.monotonically_increasing_id())
    rows = materialize(rows)
    fit = rows.where(F.col("n_words") >= least_words)
    n = fit.count() * percent // 100
    last = last_drawn(fit, n, keys) if n else []
    drawn = F.col("n_words") >= least_words
    drawn = drawn & (up_to(keys, last) if last else F.lit(n > 0))
    told = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(drawn), keys).select(*told).unionByName(rest.select(*told)) if n else rest.select(*told)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of benchmark, a tenth of those with 20 words."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 is not a function of DuckDB: its table of 256 is made by the rule (polynomial 0xEDB88320), then each distinct word is reduced.
OP13_SQL = rf"""
with recursive steps(byte, c, k) as (
  select b, b::bigint, 0 from range(256) r(b)
  union all select byte, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by byte) as t from steps where k = 8),
said as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
ours as (select row, unnest(w) as f from said),
theirs as (select unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) as f from benchmark),
vocabulary as (select f, hex(encode(f)) as h from (select f from ours union select f from theirs)),
hashed as (
  select f, xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::bigint + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % {BUCKETS} as bucket
  from vocabulary, crc),
s as (select bucket, count(*) as s from ours join hashed using (f) group by bucket),
t as (select bucket, count(*) as t from theirs join hashed using (f) group by bucket),
sums as (select (select coalesce(sum(s), 0) from s)::double as all_s, (select coalesce(sum(t), 0) from t)::double as all_t),
gains as (
  select b as bucket, floor(1000.0::double * ln((coalesce(t, 0) + 1)::double * (all_s + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * (all_t + {BUCKETS}))))::bigint as gain
  from range({BUCKETS}) r(b) left join s on s.bucket = b left join t on t.bucket = b cross join sums),
weights as (select row, sum(gain)::bigint as total from ours join hashed using (f) join gains using (bucket) group by row),
scored as (
  select doc_id, row, len(w)::bigint as n_features,
    coalesce(case when total >= 0 then total // len(w) else -((-total + len(w) - 1) // len(w)) end, 0)::bigint as weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from said left join weights using (row)),
noisy as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from scored),
placed as (
  select *, row_number() over (order by n_features < {LEAST_WORDS}, score desc, doc_id nulls last, n_features) as place,
    (count(*) filter (n_features >= {LEAST_WORDS}) over ()) * {PERCENT} // 100 as drawn from noisy)
select doc_id, n_features, weight, score, case when place <= drawn then place end::bigint as rank from placed
"""
