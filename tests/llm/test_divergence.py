"""The source audit against plain integers, its dedup of count vectors, and cases that have no kept term or one source."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import source_divergence as D


def plain(docs, least, top):
    low = lambda t: re.findall(D.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts, inside, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        counts[lang, source].update(low(text))
        inside[lang].update(set(low(text)))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in inside[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            for part, rows in (("pair", [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]), ("term", [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]])):
                order = sorted(rows, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10, 10_000])
@pytest.mark.parametrize("cells", [1, D.CELLS])
def test_against_plain_integers(spark, least, cells, monkeypatch):
    monkeypatch.setattr(D, "CELLS", cells)
    monkeypatch.setattr(D, "PART_VECTORS", 7)
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["Mill", "rye", "Ä", "ä", "x1y", "ſ", "K"] + [f"w{'abcdefghij'[k]}" for k in range(10)]) for _ in range(n))
    docs = [(say(rng.randrange(30)), rng.choice(["en", "en", "en", None, "", "de"]), rng.choice(["a", "a", "b", None, "Ä", "c c"])) for _ in range(120)]
    docs += [(None, "en", "empty"), ("", "xx", "alone"), ("!! 12", "yy", "p"), (None, "yy", "q"), (say(20_000), "de", "long")]
    docs += [("rare once", "en", "a")] * 3
    df = spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, value int")
    got = D.audit(df, least, 10).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == plain(docs, least, 10)


def test_many_terms_of_one_vector(spark):
    names = [f"t{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    docs = [(" ".join(names), "en", "a")] * 12 + [("other word", "en", "b")] * 12
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    vectors = D.kept_terms(df.select("lang", "source", D.terms(df["text"]).alias("terms")))
    assert vectors.count() == 402 and vectors.select("sources", "counts").distinct().count() == 2
    assert sorted(map(tuple, D.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())) == plain(docs, 10, 10)


def test_shares_are_exact_for_large_counts():
    counts, wholes = np.array([[0, 10**9, 8 * 10**15]]), np.array([9 * 10**15, 10**10 + 7, 9 * 10**15])
    assert D._shares(counts, wholes).tolist() == [[1 + 10**9 * (c + 2) // w for c, w in zip(counts[0].tolist(), wholes.tolist())]]
