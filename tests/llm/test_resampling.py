"""Radix selection and ranking against sorting, gains and features of several words against plain Python, skew and odd keys."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.llm import importance_resampling as R

FULL = 2**63


@pytest.mark.parametrize("values", [[5] * 40, list(range(50)), [-FULL, FULL - 1, 0, -1, 1] * 8, [random.Random(1).randrange(-FULL, FULL) for _ in range(60)], [random.Random(2).randrange(3) << 40 for _ in range(60)]])
def test_selection_finds_the_exact_last_key(spark, values):
    rows = spark.createDataFrame([(v, k % 4 - 2, k) for k, v in enumerate(values)], "a long, b long, c long").repartition(3)
    want = sorted((v, k % 4 - 2, k) for k, v in enumerate(values))
    for n in (1, 7, len(values) - 1, len(values)):
        last = R.last_drawn(rows, n, ["a", "b", "c"])
        assert (last is None) == (n == len(values))
        got = sorted(map(tuple, rows.where(R.up_to(["a", "b", "c"], last or [])).collect()))
        assert got == want[:n]


def test_ranks_are_those_of_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    assert sorted((r["a"], r["b"], r["rank"]) for r in R.ranked(df, ["a", "b"]).collect()) == [(*x, k + 1) for k, x in enumerate(sorted(rows))]


def plain(docs, target, longest, buckets):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    cell = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(cell(f) for t in docs for f in runs(low(t)))
    t = Counter(cell(f) for x in target for f in runs(low(x)))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    return gain, [(len(f := runs(low(x))), sum(gain[cell(y)] for y in f) // len(f) if f else 0) for x in docs]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_gains_and_weights(spark, longest):
    rng = random.Random(4)
    docs = [" ".join(rng.choice(["Mill", "RYE", "brot-1", "mühle", "x9", "ÄÖ"]) for _ in range(rng.randrange(0, 40))) for _ in range(50)] + [None, "", "One", "!?"]
    target = ["rye mill rye", None, "", "x9 mühle brot"]
    d, t = spark.createDataFrame([(k, x) for k, x in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    gain, want = plain(docs, target, longest, 64)
    assert R.gains(d, t, 64, longest) == gain
    assert [(r["n_features"], r["weight"]) for r in R.scored(d, gain, longest).orderBy("doc_id").collect()] == want


def test_one_row_repeated_and_ids_without_number(spark):
    text = " ".join(["mill"] * 25)
    docs = spark.createDataFrame([(7, text)] * 400 + [(None, text)] * 200 + [(k, text + f" w{k}") for k in range(100, 130)] + [(8, "too short")], "doc_id long, text string")
    got = R.resample(docs, docs.limit(0), percent=50).collect()
    assert len(got) == 631 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 316))
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in drawn] == sorted((r["score"] for r in got if r["n_words"] >= 20), reverse=True)[:315]
    assert all(r["rank"] is None for r in got if r["doc_id"] == 8)


def test_nothing_is_drawn_of_too_few(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in R.resample(docs, docs).collect()] == [None]
    assert [r["rank"] for r in R.resample(docs, docs, percent=100).collect()] == [1]


def test_the_array_of_gains_is_a_constant(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = R.scored(docs, [1] * 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    assert R.scored(docs.select("doc_id", F.lit(None).cast("string").alias("text")), [1] * 16).first()["weight"] == 0
