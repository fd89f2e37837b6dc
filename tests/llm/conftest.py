"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the river stone under old bridge carries water to a mill where seven people grind wheat barley and rye for bread".split()
GERMAN = "der alte fluss trägt das wasser zur mühle wo sieben leute weizen gerste und roggen für das brot mahlen".split()
#: Names the operators use inside.
CLASHING = "size range fp component sig row data bucket part lang_pred score header payload class_id copies rank cb salt length start n terms sources counts place value words features weight score _copy _id".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(n))


def documents():
    rng = random.Random(5)
    rows = [(i, prose(rng, WORDS if i % 2 else GERMAN, rng.randrange(5, 120)), "en" if i % 2 else "de", rng.choice(["web", "web", "book", "code", None])) for i in range(120)]
    passage = prose(rng, WORDS, 60)
    rows += [(200 + k, f"{prose(rng, WORDS, 20)} {passage} {prose(rng, WORDS, 15)}", "en", "web") for k in range(5)]
    rows += [(300 + k, rows[3][1], "en", "web") for k in range(8)]
    rows += [(320, passage + " " + passage, "en", "book"), (321, "ab" * 400, None, "web"), (322, "x" * 350, None, "web")]
    rows += [(330, None, "en", "web"), (331, "", "en", "web"), (332, " \t\n ", "de", None), (333, "12345 67", None, "code"), (334, "One", "en", "code")]
    rows += [(340, prose(rng, WORDS, 9000), "en", "book"), (341, "ß𝒳é " * 90, "de", "book"), (341, "ß𝒳é " * 90, "de", "book")]
    rows += [(None, "nobody named this text " + prose(rng, WORDS, 30), "en", "web"), (-7, "Minus SEVEN keeps the mill and the bridge", "en", "web")]
    rows += [(350, "Notes on the mill. Licensed under the Apache License, Version 2.0. More notes follow.", "en", "code"), (351, "We spoke of a licence to fish in the river.", "en", "web")]
    return rows


def embeddings():
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(60)]
    rows = [(i, v, i % 3) for i, v in enumerate(base)]
    rows += [(100 + k, [x + rng.gauss(0, 0.05) for x in base[k % 6]], (k % 6) % 3) for k in range(80)]
    rows += [(200 + k, base[0], 0) for k in range(30)]
    odd = [None, [0.0] * 12, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11]
    rows += [(300 + 20 * k, v, 0) for k, v in enumerate(odd)] + [(420, base[1], None), (440, base[2], 0), (460, base[2], 1)]
    return rows


def pages():
    body = "<p>" + "mill " * 30 + "</p>"
    rows = [(k, f"http://a.example/{k}", body if k % 3 == 0 else f"<p>page {k // 2}</p>") for k in range(1, 60)]
    return rows + [(100, None, None), (101, "http://b.example/\r\nX: y", ""), (102, "http://c.example/é", "ü𝒳" * 50), (103, "http://d.example/", "z" * 100_000)]


def benchmark():
    rng = random.Random(7)
    return [(k, prose(rng, WORDS, 30)) for k in range(20)] + [(50, None), (51, ""), (51, "Ünïcode MILL mill 12 a-b")]


def put(folder, name, columns, rows, clash):
    table = pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(columns)})
    for c in clash:
        if c not in table.column_names:
            table = table.append_column(c, pa.array(["other"] * len(rows), pa.string()))
    pq.write_table(table, f"{folder}/{name}.parquet")


def tables(folder, full):
    docs = [(*r, len(r[1]) if r[1] is not None else None) for r in documents()] if full else []
    put(folder, "documents", [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())], docs, CLASHING)
    put(folder, "embeddings", [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int64())], embeddings() if full else [], CLASHING)
    put(folder, "pages", [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())], pages() if full else [], CLASHING)
    put(folder, "benchmark", [("item_id", pa.int64()), ("text", pa.string())], benchmark() if full else [], CLASHING)
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("odd"), True)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), False)


@pytest.fixture(scope="session")
def small_dir():
    found = "/root/testdata/sf0.001"
    if not os.path.isdir(found):
        pytest.skip("needs the driver's tables")
    return found
