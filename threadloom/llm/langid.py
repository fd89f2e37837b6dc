"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. An n-gram binds the vectors of its letters, each permuted by its place, by
component-wise multiplication; a text bundles (adds) the vectors of its n-grams; a language's prototype bundles its training
texts. A text gets the language whose prototype has the largest cosine with it."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

from .common import bound_batches, give_back

DIMENSIONS, N, SYMBOLS = 1024, 3, 64
UNKNOWN = "und"
#: Prototypes are one vector per language; more languages than this is an error rather than an unbounded driver table.
MOST_LANGUAGES = 8192
_CHUNK, _GROUP, MOST_KEPT = 1 << 20, 128, 8192


def _symbols() -> np.ndarray:
    """Symbol of every code point: a to z are 1 to 26, other letters share the rest by code point, anything else is 0."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            table[cp] = cp - 96 if "a" <= c <= "z" else 27 + cp % (SYMBOLS - 27)
    return table


@F.pandas_udf(BooleanType())
def has_letter(text: pd.Series) -> pd.Series:
    """Whether a text has a letter, by the same table of letters as the profiles; null has none."""
    table = profiles(DIMENSIONS, N).table
    return text.map(lambda t: t is not None and any(table[np.frombuffer(t[i : i + _CHUNK].encode("utf-32-le", "replace"), np.uint32)].any() for i in range(0, len(t), _CHUNK)))


class Profiles:
    """Letter vectors and the n-gram vectors bound so far, the same in every process."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N):
        self.n, self.d = n, dimensions
        self.table = _symbols()
        seeds = [hashlib.shake_256(f"letter {s}".encode()).digest(dimensions // 8) for s in range(SYMBOLS)]
        letters = np.stack([np.unpackbits(np.frombuffer(s, np.uint8)).astype(np.float32) * 2 - 1 for s in seeds])
        self.row, self.kept, self.used = np.full(SYMBOLS**n, -1, np.int32), np.empty((2048, dimensions), np.float32), 0
        self.placed = [np.roll(letters, place, axis=1) for place in range(n)]

    def codes(self, text: str) -> np.ndarray:
        """N-gram codes of a text: letters in lower case, every run of other characters one gap, gaps at both ends."""
        out = []
        for i in range(0, len(text), _CHUNK):
            s = self.table[np.frombuffer(text[i : i + _CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)]
            out.append(s)
        s = np.concatenate([[np.uint8(0)], *out, [np.uint8(0)]])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])].astype(np.int32)
        if len(s) < 3:
            return s[:0]
        code = s[: len(s) - self.n + 1].copy()
        for k in range(1, self.n):
            code = code * SYMBOLS + s[k : len(s) - self.n + 1 + k]
        return code

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The bound vectors of these codes; up to MOST_KEPT of them are kept for the next group."""
        new = codes[self.row[codes] < 0]
        if self.used + len(new) > MOST_KEPT:
            return self.bind(codes)
        if len(new):
            while self.used + len(new) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.empty_like(self.kept)])
            self.kept[self.used : self.used + len(new)] = self.bind(new)
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.kept[self.row[codes]]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.d), np.float32)
        for k in range(self.n):
            out *= self.placed[k][codes // SYMBOLS ** (self.n - 1 - k) % SYMBOLS]
        return out

    def bundle(self, codes: list[np.ndarray]) -> np.ndarray:
        """One bundled vector per text of a small group of texts."""
        every = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        if not len(every):
            return np.zeros((len(codes), self.d), np.float32)
        seen = np.flatnonzero(np.bincount(every, minlength=SYMBOLS**self.n))
        place = np.zeros(SYMBOLS**self.n, np.int32)
        place[seen] = np.arange(len(seen), dtype=np.int32)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        counts = np.bincount(owner * len(seen) + place[every], minlength=len(codes) * len(seen)).reshape(len(codes), len(seen)).astype(np.float32)
        return counts @ self.vectors(seen)


_PROFILES: dict[tuple[int, int], Profiles] = {}


def profiles(dimensions: int, n: int) -> Profiles:
    if (dimensions, n) not in _PROFILES:
        _PROFILES[dimensions, n] = Profiles(dimensions, n)
    return _PROFILES[dimensions, n]


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; rows without an id are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, n: int = N) -> dict[str, np.ndarray]:
    """Prototype of each language from every row of `labelled` whose language and text are not null.

    A task returns one partial sum per language, so what reaches the driver is one vector per language."""

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles(dimensions, n)
        sums: dict[str, np.ndarray] = {}  # one vector per language is all that is held; sums of integers, so their order is free
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by.setdefault(lang, []).append(p.codes(text.as_py()))
            for lang, codes in by.items():
                counts = np.bincount(np.concatenate(codes), minlength=SYMBOLS**n)
                seen = np.flatnonzero(counts)
                total = sums.setdefault(lang, np.zeros(dimensions))
                for i in range(0, len(seen), 4096):
                    part = seen[i : i + 4096]
                    total += counts[part].astype(np.float64) @ p.vectors(part)
        give_back()
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], names=["lang", "i", "v"])

    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    summed = rows.mapInArrow(partial_sums, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    per_lang = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).getField("v").alias("v"))
    found = per_lang.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: np.asarray(r["v"]) for r in found}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS, n: int = N) -> DataFrame:
    """All columns of `docs` with lang_pred and score (the winning cosine, not below 0), replacing columns of these names.

    Null texts, texts without a letter, and every text when nothing was learned get `und` and score 0. Ties go to the language
    first in code-point order."""
    bound_batches(docs.sparkSession)
    langs = sorted(prototypes)
    unit = np.stack([prototypes[k] / (np.linalg.norm(prototypes[k]) or 1) for k in langs]) if langs else np.zeros((0, dimensions))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles(dimensions, n)
        for batch in batches:
            pred, score = [], []
            texts = batch.column(at)
            for i in range(0, len(texts), _GROUP):
                codes = [p.codes(t.as_py()) if t.is_valid else np.zeros(0, np.int32) for t in texts[i : i + _GROUP]]
                sums = p.bundle(codes).astype(np.float64)
                norm = np.linalg.norm(sums, axis=1)
                cosine = np.round(sums @ unit.T / np.where(norm > 0, norm, 1)[:, None], 9)
                for c, row in zip(codes, cosine):
                    known = len(c) > 0 and len(langs) > 0
                    best = int(row.argmax()) if known else -1
                    pred.append(langs[best] if known else UNKNOWN)
                    score.append(float(min(1.0, max(0.0, row[best]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])
        give_back()

    return docs.select(*kept).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` with held_out, lang_pred and score; learned from the rows that are not held out."""
    prototypes = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    return predict(docs.withColumn("held_out", held_out(F.col(id_col))), prototypes, text_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(asked, prototypes).select("doc_id", "held_out", "lang_pred", "score")
