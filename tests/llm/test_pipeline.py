"""Each stage on what its predecessor kept, against plain Python over the same rows."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from test_brute_force import components, plain_fingerprint

from threadloom.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, odd_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, seen = spark.read.parquet(f"{odd_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, odd_dir).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        seen.append(docs)
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
    return [spark.read.parquet(f"{odd_dir}/documents.parquet").select(*P.COLUMNS).collect(), *[d.collect() for d in seen]]


def rows(docs):
    return Counter((r.doc_id, r.text) for r in docs)


def test_language(stages):
    before, after = stages[0], stages[1]
    assert rows(after) == Counter({k: n for k, n in rows(before).items() if any(c.isalpha() for c in k[1] or "")})
    known = {(r.doc_id, r.text): r.lang for r in before}
    right = [known[r.doc_id, r.text] == r.lang for r in after if known[r.doc_id, r.text] and len(r.text) > 40]
    assert all(r.lang for r in after) and sum(right) >= 0.95 * len(right)


def test_language_without_labels_keeps_clean_documents(spark):
    docs = spark.createDataFrame([(1, "some words", None, "web", 10), (2, "12 34", None, "web", 5), (3, None, None, "web", None), (4, "\U00030001\U00031350", None, "web", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.language(spark, docs, "").collect()} == {1, 4}


def kept(docs):
    """One row per group of near duplicates: the smallest (id, text) of the rows, ids that are missing last."""
    docs = list(rows(docs))
    fps = [plain_fingerprint(t) for _, t in docs]
    group = components(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    return docs, group


def test_near_dedup(stages):
    docs, group = kept(stages[1])
    found = rows(stages[2])
    assert set(found.values()) == {1} and Counter(group[docs.index(d)] for d in found) == Counter(set(group))
    for d in found:
        own = [e[0] for e, g in zip(docs, group) if g == group[docs.index(d)]]
        assert d[0] == min((i for i in own if i is not None), default=None)


def test_near_dedup_of_one_id_with_two_texts(spark):
    long = "the mill by the river grinds wheat barley and rye for all the people of the old town"
    texts = [(1, long), (1, "seven boats carry stone under a bridge while the water is low in the late summer"), (2, long), (2, long), (None, long), (None, "nobody named this text but it is here"), (None, "nobody named this text but it is here")]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()]
    assert Counter(got) == Counter([texts[0], texts[1], texts[5]])


def test_substring_dedup(stages):
    before, seen, want = stages[2], set(), Counter()
    for doc, text in sorted(rows(before), key=lambda d: (d[0] is None, d[0] or 0)):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(data[i : i + 100])
        left = bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        if left:
            want[doc, left] += 1
    assert rows(stages[3]) == want and all(r.n_chars == len(r.text) for r in stages[3])


def budgets(docs):
    """Each source's words: the excess over three times its size is shared again by weight, round by round."""
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weights = sum(weight[s] for s in order if s not in capped)
        goal = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / weights for s in order}
        over = {s for s in order if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            return sizes, goal
        capped |= over


def words_of(docs):
    out = defaultdict(int)
    for r in docs:
        out[r.source] += len(WORD.findall(r.text or ""))
    return out


def check_mixture(before, after):
    sizes, goal = budgets(before)
    got = words_of(after)
    assert {s: got[s] for s in goal} == {s: int(goal[s] + 0.5) for s in goal}
    texts = defaultdict(Counter)
    for r in before:
        texts[r.doc_id, r.source][r.text] += 1
    held, parts = Counter(), Counter()
    for r in after:
        own = texts[r.doc_id, r.source]
        if r.text in own:
            held[r.doc_id, r.source, r.text] += 1
        else:
            assert any((t or "").startswith(r.text) for t in own)
            parts[r.source] += 1
        assert r.n_chars == len(r.text)
    assert all(n <= 1 for n in parts.values())
    assert all(n <= 3 * texts[d, s][t] for (d, s, t), n in held.items())


def test_mixture(stages):
    check_mixture(stages[3], stages[4])


@pytest.mark.parametrize("copies", [4, 7])
def test_mixture_with_repeated_rows_and_ids(spark, copies):
    base = [(k % 6, f"w{k} " + " ".join(f"x{k * i % 7}" for i in range(3 + 5 * k)), "en", ("a", "b", None)[k % 3]) for k in range(12)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in base for _ in range(copies)], "doc_id long, text string, lang string, source string, n_chars long")
    check_mixture(docs.collect(), P.mixture(spark, docs, "").collect())


def test_targets_by_rounds(spark):
    for sizes in ({"a": 5, "b": 1000, "c": 400, "d": 7, None: 300}, {"x": 10}, {"a": 0, "b": 3}, {f"s{k:02}": 3**k % 997 for k in range(20)}):
        docs = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(docs).collect()}

        class Row:
            def __init__(self, s, n):
                self.source, self.text = s, "w " * n

        _, goal = budgets([Row(s, n) for s, n in sizes.items()])
        assert got == pytest.approx(goal)


def test_ranges_do_not_change_the_mix(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    one, many = (Counter(map(tuple, mixing.mix(docs, ranges=n).collect())) for n in (1, 500))
    assert one == many


def test_packed(stages):
    from tokenizers import Tokenizer

    slow, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in stages[4]:
        ids = slow.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r.doc_id, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got, held = Counter(), defaultdict(list)
    for r in stages[5]:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        held[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
