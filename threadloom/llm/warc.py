"""Content-addressed WARC archive.

Payload bytes are stored once per strong digest (SHA-256, checked again when read), in buckets of it; the exact header block of
every record is kept apart with the digest of its payload, and the original records come back through a join of the two tables,
to which only the headers travel."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import look_up, materialize, shared_dir

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 0
# The base-32 alphabet, and the profile of a revisit by identical payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: five hex digits make four base-32 digits."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), HEX32, BASE32)


def _payload(payload_col: str) -> Column:
    return F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")


def records(pages: DataFrame, least: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One record per page, without its payload: page_id, record_type, refers_to, payload_bytes, payload_digest, content_key, header.

    Of pages with equal payloads of at least `least` bytes the smallest id is the response and the others revisit it. Rows that
    repeat that smallest id, and rows without an id whose group has no id at all, are responses, too. A null payload is empty; a
    page without a URL is its own target. Record ids name page and payload, so two payloads under one page_id have two. Other
    columns are not read. Payloads are hashed where they are read; only their digests travel."""
    payload = _payload(payload_col)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("content_key"), base32_sha1(payload).alias("payload_digest"))
    first = base.where(F.col("payload_bytes") >= least).groupBy("content_key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    joined = look_up(base, materialize(first.where("n > 1")), "content_key", "n")
    revisit = F.coalesce((F.col("page_id") != F.col("first_id")) | (F.col("page_id").isNull() & F.col("first_id").isNotNull()), F.lit(False))
    typed = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), F.substring("content_key", 1, 16))
    record_id = lambda c: F.concat(F.lit("<"), name(c), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), name(F.col("page_id")))),
        F.lit(f"WARC-Date: {EPOCH}\r\n"),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("refers_to")))).otherwise(""),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n")).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return typed.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "content_key", header.alias("header"))


_STORED = "content_key string, payload binary"


def _as_table(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The payload store under `path` as a table that Spark knows to be dealt by content key; the name is gone afterwards."""
    name = f"threadloom_warc_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({_STORED}) using parquet clustered by (content_key) sorted by (content_key) into {buckets} buckets location '{path}/payloads'")
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # an external table: its files stay
    return found


def write_archive(pages: DataFrame, path: str, payload_col: str = "html", **options) -> None:
    """Three tables under `path`: headers (one row per record, bytes exact), payloads (one row per content key, in buckets of
    that key), layout (the number of buckets, that of the shuffle partitions).

    A payload travels once, on its way to its bucket; equal ones collapse before that within each task."""
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = records(pages, payload_col=payload_col, **options)
    found.select("page_id", "record_type", "content_key", F.encode("header", "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    payload = _payload(payload_col)
    stored = pages.select(F.sha2(payload, 256).alias("content_key"), payload.alias("payload")).groupBy("content_key").agg(F.any_value("payload").alias("payload"))
    name = f"threadloom_warc_{uuid.uuid4().hex}"
    stored.write.bucketBy(buckets, "content_key").sortBy("content_key").option("path", f"{path}/payloads").format("parquet").saveAsTable(name)
    spark.sql(f"drop table {name}")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, content_key, record_type, record: every record as it stands in a WARC file, that is header block, payload unless a
    revisit, two line ends.

    Headers of responses meet the payloads in their buckets, so payloads do not travel; each is verified against its key."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = _as_table(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])
    verified = F.when(F.sha2("payload", 256) == F.col("content_key"), F.col("payload"))
    checked = F.coalesce(verified, F.raise_error(F.concat(F.lit("payload does not match its digest "), "content_key")).cast("binary"))
    whole = lambda body: F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record")
    responses = headers.where("record_type = 'response'").join(payloads, "content_key", "left").select("page_id", "content_key", "record_type", whole(checked))
    return responses.unionByName(headers.where("record_type <> 'response'").select("page_id", "content_key", "record_type", whole(F.lit(b""))))


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload of every record, that of a revisit taken from the store, too."""
    payloads = _as_table(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])
    return spark.read.parquet(f"{path}/headers").join(payloads, "content_key").select("page_id", "header", "payload")


def described(read: DataFrame) -> DataFrame:
    """What the records say of themselves: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok.

    Length and digest of a response are those of its own bytes, which must agree with its header (digest_ok); a revisit has those
    of the response that has its content key."""
    end = F.locate("\r\n\r\n", F.decode("record", "ISO-8859-1")) + 3  # one character a byte
    body = F.expr("substring(record, _end + 1, octet_length(record) - _end - 4)")
    split = read.withColumn("_end", end).select("content_key", F.decode(F.expr("substring(record, 1, _end)"), "UTF-8").alias("text"), F.octet_length(body).cast("long").alias("n"), base32_sha1(body).alias("digest"))
    field = lambda name: F.nullif(F.regexp_extract("text", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    page = lambda name: F.nullif(F.regexp_extract("text", rf"\r\n{name}: <urn:page:(-?[0-9]+):", 1), F.lit("")).cast("long")
    told = split.select("content_key", "n", "digest", page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("said"), field("Content-Length").cast("long").alias("said_n"))
    told = materialize(told)  # one short row per record: payloads are read once
    sound = (F.col("said") == F.col("digest")) & (F.col("said_n") == F.col("n"))
    of_key = told.groupBy("content_key").agg(F.max(F.when(F.col("record_type") == "response", F.struct("n", "digest"))).alias("held"), F.count_if(F.col("record_type") == "revisit").alias("asked"))
    own = told.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", sound.alias("digest_ok"))
    revisits = look_up(told.where("record_type <> 'response'"), materialize(of_key.where("asked > 0")), "content_key", "asked")
    other = revisits.select("page_id", F.col("held.n").alias("payload_bytes"), F.col("held.digest").alias("payload_digest"), "record_type", "refers_to", (F.col("said") == F.col("held.digest")).alias("digest_ok"))
    return own.unionByName(other)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages under the shared folder, read the archive back, answer from the records' bytes."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return described(read_archive(spark, path))


OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, payload, octet_length(payload) as payload_bytes, sha1(payload) as hex from p),
f as (select *, min(page_id) over (partition by payload) as first_id from d)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to, true as digest_ok
from f
"""
