"""Operators that SQL cannot express, against plain Python over the same rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import hnsw_dedup, langid, license_scan, packing, sharding, simhash, suffix_dedup, topk, warc


def docs_of(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"] or "") for r in t]


def components(n, near):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("where", ["odd_dir", "small_dir"])
def test_simhash(spark, where, request):
    folder = request.getfixturevalue(where)
    docs = docs_of(folder)
    fps = [plain_fingerprint(t) for _, t in docs]
    group = components(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    want = Counter((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(docs, fps, group))
    assert Counter(map(tuple, simhash.op3_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect())) == want


@pytest.mark.parametrize("hot", [3, 2048])
def test_simhash_links_with_crowded_signatures(spark, hot):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centres for k in (0, 1, 1, 1, 2, 2, 3, 4) for _ in range(12)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    found = [((a % 2**64), (b % 2**64)) for a, b in simhash.links(df, hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    pairs = set(found) | {(b, a) for a, b in found}
    same = lambda near: len(set(components(len(fps), near)))
    assert same(lambda i, j: (fps[i], fps[j]) in pairs) == same(lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)


@pytest.mark.parametrize("hot", [1, 4, suffix_dedup.HOT_GRAM])
@pytest.mark.parametrize("where", ["odd_dir", "small_dir"])
def test_suffix_dedup(spark, where, hot, request):
    folder = request.getfixturevalue(where)
    docs = docs_of(folder)
    unique = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))  # rows that repeat id and text are one document
    seen, want = set(), {}
    for doc, text in unique:
        data, gone = text.encode(), bytearray(len(text.encode()))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(data[i : i + 100])
        spans = bytes(gone).replace(b"\x00", b" ").split()
        left = bytes(c for c, g in zip(data, gone) if not g)
        want[doc, text] = (doc, len(data), sum(gone), len(spans), hashlib.sha256(left).hexdigest())
    got = suffix_dedup.op8_suffix_dedup(spark, folder, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want[d] for d in docs)
    assert any(w[2] for w in want.values())


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT_GRAM])
def test_suffix_dedup_whatever_the_order_of_rows(spark, odd_dir, hot):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    asked = lambda df: Counter(map(tuple, suffix_dedup.remove_repeats(df, hot=hot).drop("kept").collect()))
    want = asked(docs.coalesce(1).sortWithinPartitions("doc_id"))
    for seed in (1, 2):
        assert asked(docs.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(seed)))) == want
        assert asked(docs.repartition(3, F.xxhash64("text", F.lit(seed)))) == want


def test_packing(spark, odd_dir):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for doc, text in docs_of(odd_dir):
        ids = slow.encode(text, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = packing.op4_packing(spark, odd_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 2048) + 1


def test_packing_plan_places_every_length():
    rng = random.Random(2)
    counts = Counter(rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300), 700, 1100]) for _ in range(5000))
    plan = packing.plan(dict(counts))
    placed = Counter()
    for many, lengths in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            placed[x] += many
    assert placed == counts


def test_sharding(spark, odd_dir):
    got = sharding.op5_sharding(spark, odd_dir).collect()
    docs = docs_of(odd_dir)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.map_version for r in got} == {1} and all(r.next_shard in (24, r.shard) for r in got)
    assert len({(r.virtual_slot, r.shard, r.next_shard) for r in got}) == len({r.virtual_slot for r in got})


def test_sharding_balances_bytes(spark):
    rng = random.Random(4)
    texts = ["é" * rng.randrange(1, 2000) if k % 3 else "copy " * 100 for k in range(30_000)] + ["x" * 150_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = sharding.build_map(docs, 24)
    for m, shards in ((first, 24), (sharding.rebalanced(first, 25), 25), (sharding.rebalanced(first, 20), 20)):
        held = Counter()
        for r in sharding.assign(docs, m).select("shard", "size").collect():
            held[r.shard] += r["size"]
        mean = sum(held.values()) / shards
        assert sum(held.values()) == sum(len((t or "").encode()) + 8 for t in texts) and len(held) == shards
        assert max(held.values()) <= 1.01 * mean and min(held.values()) >= 0.99 * mean


@pytest.mark.parametrize("repeated", ["id", "row", "text", "two ids"])
def test_sharding_balances_bytes_of_repeated_rows(spark, repeated):
    text = lambda k: f"{k % 10**6:06d}" + "x" * 44
    rows = [(k, text(k)) for k in range(4000)]
    rows += {"id": [(7, text(k)) for k in range(4000)], "row": [(7, text(7))] * 4000, "text": [(9000 + k, text(7)) for k in range(4000)], "two ids": [(7 + k % 2, text(7)) for k in range(4000)]}[repeated]
    rows = sharding.records(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    first = sharding.build_map(rows, 24)
    for m, shards in ((first, 24), (sharding.rebalanced(first, 25), 25)):
        got = sharding.assign(rows, m).collect()
        held = Counter(r.shard for r in got)
        assert len(got) == 8000 and all(r["size"] == 58 for r in got) and len(held) == shards
        assert max(held.values()) <= min(held.values()) * 1.01 + 1
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert any(r[5] for r in first) == (repeated in ("row", "two ids"))
    assert max(Counter(r.virtual_slot for r in got).values()) < 40


def test_sharding_map_versions(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    first = sharding.build_map(docs, 8)
    grown = sharding.rebalanced(first, 9)
    assert {r[1] for r in first} == set(range(sharding.SLOTS)) and {r[0] for r in grown} == {2}
    was = {r[1]: r[2] for r in first}
    assert all(r[2] in (8, was[r[1]]) for r in grown)
    assert {r[2] for r in sharding.rebalanced(grown, 3)} == {0, 1, 2}
    for m in (first, grown, grown):
        sharding.save_map(spark, m, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 1) == first and sharding.load_map(spark, str(tmp_path / "map")) == grown


def test_warc_round_trip(spark, odd_dir, tmp_path):
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    headers = {r.page_id: r.header.encode() for r in warc.records(pages).collect()}
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    back = warc.pages_of(spark, path).collect()
    assert {r.page_id: (bytes(r.payload), bytes(r.header)) for r in back} == {k: (html[k], headers[k]) for k in html}
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len(set(html.values()))
    read = warc.read_archive(spark, path)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # only headers are dealt anew, payloads are read in their buckets
        plan = warc.read_archive(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    got = read.collect()
    assert Counter(r.page_id for r in got) == Counter(html.keys())
    for r in got:
        header = headers[r.page_id]
        assert bytes(r.record) == header + (b"" if b"WARC-Type: revisit" in header else html[r.page_id]) + b"\r\n\r\n"
        assert b"WARC-Target-URI: " in header
    assert all(r.digest_ok for r in warc.described(read).collect())


def test_warc_repeated_ids_and_rows(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "other"), (2, "u", "same"), (None, "n", "same"), (None, None, "alone"), (3, None, None), (4, None, "")]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    read = warc.read_archive(spark, path)
    ids = Counter(re.search(rb"WARC-Record-ID: (\S+)", bytes(r.record)).group(1) for r in read.collect())
    assert sorted(ids.values()) == [1, 1, 1, 1, 1, 1, 2]  # rows that repeat id and payload are one record, written twice
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.digest_ok) for r in warc.described(read).collect())
    assert got == Counter([(1, 4, "response", None, True)] * 2 + [(1, 5, "response", None, True), (2, 4, "revisit", 1, True), (None, 4, "revisit", 1, True), (None, 5, "response", None, True), (3, 0, "response", None, True), (4, 0, "revisit", 3, True)])


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    changed = t["MIT"].replace("any person", "each person").replace("to deal in", "to use")
    rows = [(1, f"Some code.\n{t['Apache-2.0-notice']}\nint main;"), (2, changed), (3, "A licence to fish in this river is given to nobody, licensed boats or not."), (4, None), (5, ""), (6, t["BSD"] + "\n" + t["CC-BY-4.0"]), (7, "x " * 50_000 + "\n" + t["GPL-3.0-notice"]), (7, "x " * 50_000 + "\n" + t["GPL-3.0-notice"])]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter({(1, "Apache-2.0-notice"): 1, (2, "MIT"): 1, (6, "BSD"): 1, (6, "CC-BY-4.0"): 1, (7, "GPL-3.0-notice"): 2})
    assert next(r.wording for r in got if r.doc_id == 2) == "-any -deal -in +each +use"
    text = dict(rows)
    assert all(text[r.doc_id][r.block_start : r.block_end].split()[0] == t[r.license].split()[0] for r in got)
    assert license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect() == []


@pytest.mark.parametrize("where", ["odd_dir", "small_dir"])
def test_language_id_held_out(spark, where, request):
    folder = request.getfixturevalue(where)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").distinct()
    got = langid.op10_language_id(spark, folder).distinct()
    rows = docs.join(got, "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    asked = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und" and len(r.text) > 40]
    assert sum(r.lang == r.lang_pred for r in asked) >= 0.9 * len(asked) > 0


def test_graph_shards_find_what_brute_force_finds(spark, odd_dir):
    vectors = spark.read.parquet(f"{odd_dir}/embeddings.parquet")
    one, many = (Counter(map(tuple, hnsw_dedup.near_duplicates(vectors, shard_rows=n).collect())) for n in (8192, 7))
    assert one == many
    assert hnsw_dedup.near_duplicates(vectors).where(F.col("n_links") > 0).count() > 30


@pytest.mark.parametrize("segments", [1, 2, 3, 5])
def test_reaching_finds_all_entries_at_the_cutoff(segments):
    rng = np.random.default_rng(segments)
    for low, high in ((-9, 10), (-3, 4), (-50, -10), (0, 1)):
        for _ in range(50):
            rows = list(rng.integers(low, high, (segments, 40)).astype(float))
            total = sum(rows)
            for cut in (int(total.max()), int(np.sort(total)[-5]), int(total.min()), int(total.max()) + 1, -(2**63)):
                at, found = topk.reaching(rows, cut)
                assert at.tolist() == np.flatnonzero(total >= cut).tolist() and found.tolist() == total[at].tolist()


def test_top_k_in_many_blocks_and_segments(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-2, 3) / 4 for _ in range(7)]) for i in range(150)]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {i: [int(64 * x) for x in v] for i, v in rows}
    want = set()
    for q in range(0, 150, 20):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q))[:20]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    for segments in (1, 2, 4):
        got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), segments=segments, query_block=3, candidate_block=40)
        assert set(map(tuple, got.collect())) == want
