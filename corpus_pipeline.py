"""Corpus pipeline: language ID, SimHash near-dedup, exact substring dedup, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller may write as Parquet and read again for the next
one. All stages but the last return the columns of `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import langid, mixing, packing, simhash, suffix_dedup
from threadloom.llm.common import remove, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those whose text is null or has not one letter. All others get the predicted language as
    their lang, whatever it was; where no language could be learned (no row has a lang), they keep what they have.

    Repeated rows are predicted alike and stay; an empty table gives no rows."""
    docs = docs.select(*COLUMNS)
    prototypes = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    if not prototypes:
        return docs.where(langid.has_letter(F.col("text")))
    found = langid.predict(docs, prototypes).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Near duplicates are those of op3: SimHash over shingles of three words, at most two of 64 bits apart, and whatever such links
    reach. Rows that share an id but not the text are separate documents; rows that repeat both are one."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes are cut out; a document of which no character is left goes.

    A cut inside a character drops what is left of it. n_chars is counted anew. Rows that repeat id and text are one document
    and are cut alike; rows that share only the id are separate."""
    found = suffix_dedup.remove_repeats(docs, carry=tuple(COLUMNS[:1] + COLUMNS[2:]), as_text=True).where("kept <> ''")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("_n_chars"))
    return found.select(F.col("_doc_id").alias("doc_id"), F.col("kept").alias("text"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), n_chars.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, ...: a document comes once per epoch; the one at the cut comes with its first words.

    The words of a source are its budget exactly, with repeated rows, too: each of them is a document of its own."""
    mixed = mixing.drawn(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Repeated rows give their pieces again."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing", mixture),
    ("packing", packed),
]

#: Fingerprints, suffix order and tokens are not SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a stage's folder goes once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
