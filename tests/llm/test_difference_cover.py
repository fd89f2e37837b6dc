"""Repeated word windows against plain Python: odd rows, planted passages, hot anchors in different surroundings, any order of rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import difference_cover as C


def plain(docs, window):
    """(doc, n_words, n_removed, kept) of each distinct (doc, text)."""
    least, out = {}, {}
    split = {d: (d[1] or "").encode().split() for d in set(docs)}
    for (doc, _), w in split.items():
        for i in range(len(w) - window + 1):
            key = b" ".join(w[i : i + window])
            least[key] = min(least.get(key, C.NO_ID), C.NO_ID if doc is None else doc)
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[b" ".join(w[i : i + window])] < (C.NO_ID if d[0] is None else d[0]):
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out[d] = (d[0], len(w), len(w) - len(left), b" ".join(left).decode())
    return Counter(out[d] for d in docs)


def planted():
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randrange(30)) for _ in range(n))
    passages = [say(n) for n in (49, 50, 51, 60, 80, 200)]
    docs = []
    for k in range(240):
        own = [say(rng.randrange(0, 40)) for _ in range(4)]
        for at in sorted(rng.sample(range(1, 4), 2)):
            own[at] = rng.choice(passages) + rng.choice([" ", "\t\n", "\x0b"]) + own[at]
        docs.append((k if k % 7 else None if k % 2 else 3, " ".join(own)))
    docs += [(500 + k, docs[5][1]) for k in range(30)]  # exact copies
    for k in range(60):  # near copies
        w = passages[5].split()
        w[rng.randrange(len(w))] = f"edit{k}"
        docs.append((600 + k, " ".join(w)))
    docs += [(700, " ".join(["same"] * 400)), (701, " ".join(["same"] * 70)), (-1, " ".join(["same"] * 49)), (702, passages[5] + " " + passages[5])]
    docs += [(710, "x" * 300_000 + " " + passages[4] + " " + "y" * 9000), (711, "y" * 9000 + " " + passages[4]), (712, None), (713, ""), (714, " \n")]
    return docs + docs[10:14] * 3


@pytest.mark.parametrize("most, size", [(C.MOST_HELD, C.BUCKET_BYTES), (0, 1 << 12), (40, 1 << 13)])
@pytest.mark.parametrize("period", [1, 13, 31, 50])
def test_planted_passages(spark, period, most, size):
    docs = planted()
    df = spark.createDataFrame([(*d, "other") for d in docs], "doc_id long, text string, row string").repartition(5)
    got = Counter(map(tuple, C.remove_repeats(df, period=period, most_held=most, bucket_bytes=size).collect()))
    assert got == plain(docs, C.WINDOW)


@pytest.mark.parametrize("where", ["odd_dir", "small_dir"])
def test_query(spark, where, request):
    rows = spark.read.parquet(f"{request.getfixturevalue(where)}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for (d, n, g, k), m in plain([tuple(r) for r in rows], 50).items() for _ in range(m))
    assert Counter(map(tuple, C.op11_substring_dedup(spark, request.getfixturevalue(where)).collect())) == want


def test_short_windows_and_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(C, "GROUP_BYTES", 1 << 9)
    rng = random.Random(13)
    docs = [(k % 90, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(200)))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for order in (F.col("doc_id"), F.xxhash64("text")):
        got = Counter(map(tuple, C.remove_repeats(df.coalesce(1).sortWithinPartitions(order), window=7, period=5, bucket_bytes=1 << 10).collect()))
        assert got == plain(docs, 7)


def test_covers_meet():
    for period in range(1, 80):
        c = C.cover(period)
        assert {(a - b) % period for a in c for b in c} == set(range(period))


def test_hash_of_a_word_is_that_of_its_bytes_wherever_it_stands():
    rng = random.Random(14)
    own = [bytes(rng.choice(b"abc\xc3\xa9xyz") for _ in range(rng.choice([1, 2, 3, 9, C.LONG_WORD, C.LONG_WORD + 1, 70_000]))) for _ in range(60)] + [b"z" * (3 << 20)]
    alone = [int(C.word_hashes(w)[0]) for w in own]
    assert len(set(alone)) == len(set(own))
    for glue in (b" ", b" \t\r\n\x0b\x0c "):
        assert C.word_hashes(glue + glue.join(own) + glue).tolist() == alone
    assert len(C.word_hashes(b"")) == len(C.word_hashes(b" \n")) == 0


def test_ranges_join():
    start, n = C.joined(np.array([5, 0, 2, 9]), np.array([2, 2, 3, 1]))
    assert (start.tolist(), n.tolist()) == ([0, 9], [7, 1])
