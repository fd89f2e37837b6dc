"""Texts above every slice size, and odd characters, against plain Python and the libraries themselves."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from test_brute_force import plain_fingerprint
from tokenizers import Tokenizer

from threadloom.llm import common, langid, packing, sharding, simhash, suffix_dedup


def long_text(words=340_000):
    rng = random.Random(3)
    return " ".join(rng.choice(["mill", "River", "stone", "grün", "ß𝒳é", "it's", "x1"]) + str(rng.randrange(99)) for _ in range(words))


@pytest.fixture(scope="module")
def text():
    found = long_text()
    assert len(found.encode()) > 2 << 20
    return found


def test_slices_end_at_spaces(text):
    data = text.encode()
    assert b"".join(common.spans_at_space(data)) == data and len(list(common.spans_at_space(data))) > 1
    assert list(common.spans_at_space(b"x" * (3 << 20))) == [b"x" * (3 << 20)]


def test_fingerprint_of_a_long_text(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(b"y" * (2 << 20)) == plain_fingerprint("y" * (2 << 20))


def test_language_codes_of_a_long_text(text):
    p = langid.profiles(langid.DIMENSIONS, langid.N)
    cut = langid._CHUNK
    assert len(text) > 2 * cut
    symbols = [int(p.table[ord(c)]) for c in text.lower()]
    runs = [0]
    for s in [*symbols, 0]:
        if s or runs[-1]:
            runs.append(s)
    want = [(a * langid.SYMBOLS + b) * langid.SYMBOLS + c for a, b, c in zip(runs, runs[1:], runs[2:])]
    assert p.codes(text).tolist() == want


def test_bundles_and_cosines_by_hand(spark):
    """Prototypes and predictions of a small table, letter by letter."""
    rows = [(1, "ab ba", "x"), (2, "zzz", "y"), (4, "ab", "x"), (5, None, "y"), (6, "77", "y"), (7, "\U00030001", None)]
    d, n = 64, 3
    p = langid.Profiles(d, n)
    letters = p.placed[0]

    def bundled(text):
        s = [0]
        for c in [*text.lower(), " "]:
            k = int(p.table[ord(c)])
            if k or s[-1]:
                s.append(k)
        total = np.zeros(d)
        for a, b, c in zip(s, s[1:], s[2:]):
            total += letters[a] * np.roll(letters[b], 1) * np.roll(letters[c], 2)
        return total

    want = {}
    for _, t, lang in rows:
        if t and lang:
            want[lang] = want.get(lang, 0) + bundled(t)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train(docs, dimensions=d, n=n)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, got, dimensions=d, n=n).collect()}
    for k, t, _ in rows:
        v = bundled(t or "")
        if not any(c.isalpha() for c in t or ""):
            assert told[k] == ("und", 0.0)
        else:
            cosine = {x: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for x, w in want.items()}
            best = min(cosine, key=lambda x: (-round(cosine[x], 9), x))
            assert told[k][0] == best and told[k][1] == pytest.approx(max(0, cosine[best]), abs=1e-8)


def test_suffix_dedup_of_long_texts(spark, text):
    tail = text[-700_000:]
    docs = spark.createDataFrame([(1, text), (2, "y" * 300 + tail[1000:-1000] + "z"), (3, "q" * (1 << 20))], "doc_id long, text string")
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    inner = len(tail[1000:-1000].encode())
    assert got[1] == (len(text.encode()), 0, 0) and got[3] == (1 << 20, (1 << 20) - 1, 1)
    assert got[2][0] == inner + 301 and inner <= got[2][1] <= inner + 299 and got[2][2] in (1, 2)


def test_encoder_of_a_long_text(text):
    slow = Tokenizer.from_file(packing.tokenizer_path())
    words = packing.encoder(packing.tokenizer_path())
    assert words.by_chunk
    assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def test_encoder_on_odd_characters():
    slow = Tokenizer.from_file(packing.tokenizer_path())
    words = packing.encoder(packing.tokenizer_path())
    rng = random.Random(7)
    odd = ["a", "B", "é", "e\u0301", "İ", "ſ", "ﬁ", "中", "한", "\u1100\u1161", "١", "½", "'", "'s", "'LL", "<|", "|>", "<|endoftext|>", " ", "\t", "\u00a0", "\u2003", "\n", "\u200b", "\u0301", "😀", "👩\u200d🚀", "\ufeff", "\x00", "\x02", "_", "-", "9", "ǅ", "ß", "Σ", "ς", "\U00030001"]
    for _ in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_another_tokenizer_file_is_left_to_the_library(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, slow = packing.encoder(path), Tokenizer.from_file(path)
    assert not words.by_chunk
    for text in ("It's a  Mill\n by the RIVER", "", " x"):
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids
    told = json.load(open(packing.tokenizer_path()))
    told["model"]["merges"] = told["model"]["merges"][1:] + told["model"]["merges"][:1]
    (tmp_path / "t.json").write_text(json.dumps(told))
    assert not packing.encoder(str(tmp_path / "t.json")).by_chunk


def test_long_texts_keep_their_size(spark, text):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r["size"] for r in sharding.assign(docs, sharding.build_map(docs, 3)).collect()}
    assert got == {1: len(text.encode()) + 8, 2: 8}
