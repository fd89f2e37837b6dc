"""Documents compared within their row, against plain Python and the operators in the JVM."""

import json
import random

import pytest
import test_trees as T
from pyspark.sql import functions as F

from threadloom.operators import document_diff as D, variants as V
from threadloom.plans import registry

IDENTITY = {"items": "k", "items.*.v.items": "k", "a": "k", "*": "k"}
NUMBERS = ["0", "-0", "2.50", "100.0", "-0.0", "1e2", "1E22", "2.5e-7", "1e15", "999999999999999", "9" * 38, "1" + "0" * 38, "0.1", "0.10000000000000000000001"]


def texts(rng, many):
    for k in range(many):
        b = {x: T.anything(rng, 4) for x in ("items", "a", "b")} if k % 4 else T.anything(rng, 4)
        yield json.dumps(b), json.dumps(T.changed(rng, b))
    yield from [("[1, 2]", '{"0": 1, "2": 5}'), ('{"0": 1, "10": 2, "2": 3}', "[4, 5, 6]"), ("1", "1.0"), ("1", '"1"'), ("true", "1"), ("null", "null"), ("{}", "[]"), ('{"": {"": 1}}', '{"": {"": 2}}')]
    sides = [[("p", 1), ("p", 2), ("q", 3)], [("q", 3), ("p", 1), ("p", 2)]]
    same = [json.dumps({"b": [0, {"items": [{"k": k, "v": v, "name": "N"} for k, v in side]}], "items": [{"k": k, "v": {"items": [{"k": "p"}]}} for k, _ in side]}) for side in sides]
    yield from [(same[0], same[0]), (same[0], same[1]), (same[1], same[0])]
    many = json.dumps([{"k": i, "name": {"x": [1, None, "é", 2.50]}, "v": i} for i in range(12)])
    yield from [(many, "[]"), ("[]", many), (f'{{"z": {many}}}', f'{{"z": {many[1:-1].join(["[", ", 5]"])}}}'), (many, many.replace('"v"', '"w"'))]


#: Numbers, of which Python shows some in its own way.
OF_NUMBERS = [(f'{{"n": {x}, "items": [{{"k": {x}, "v": {x}}}]}}', f'{{"n": {y}, "items": [{{"k": {y}, "v": "{y}"}}]}}') for x in NUMBERS for y in NUMBERS]


def test_as_a_walk_in_plain_python():
    rng, n = random.Random(31), 0
    of_read = lambda v: "nothing" if v is D.MISSING else D.text_of(v)
    of_plain = lambda v: "nothing" if v is T.MISSING else D.text_of(D.read(json.dumps(v)))
    for b, a in texts(rng, 3000):
        want = []
        T.walk(json.loads(b), json.loads(a), "", None, IDENTITY, "t", want)
        want = [(*x[:3], of_plain(x[3]), of_plain(x[4])) for x in want]
        got = [(*x[:3], of_read(x[3]), of_read(x[4])) for x in D.changes(D.read(b), D.read(a), IDENTITY, "t")]
        assert [x for x in got if x[0] == "modify"] == [x for x in want if x[0] == "modify"] and sorted(map(repr, got)) == sorted(map(repr, want)), (b, a)
        n += len(got)
    assert n > 5000


def test_as_the_operators_in_the_jvm(spark):
    rows = spark.createDataFrame([*((k, b, a) for k, (b, a) in enumerate([*texts(random.Random(32), 250), *OF_NUMBERS])), (9000, None, None), (9001, "[1]", None), (9002, None, "null")], "id int, b string, a string")
    diff = V.deep_diff(rows.select("id", F.parse_json("b").alias("b"), F.parse_json("a").alias("a")), "b", "a", ["id"], IDENTITY, "t").cache()
    told = lambda df: sorted(map(repr, df.collect()))
    want = told(diff.select("id", "kind", "path", "owner", V.shown_value(F.col("old")).alias("old"), V.shown_value(F.col("new")).alias("new")))
    assert told(D.diffed(rows, "b", "a", ["id"], IDENTITY, "t")) == want and len(want) > 1000
    for label in ("name", "t", "v"):
        assert told(D.told(rows, "b", "a", ["id"], IDENTITY, "t", label)) == told(V.change_lines(diff, ["id"], label).select("id", "turn", "text"))


def test_keys_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, "x", "[1]", "[2]"), (1, "x", "[1]", "[2]"), (None, "y", "[1]", "[1]")], "id int, k string, b string, a string")
    assert list(map(tuple, D.diffed(rows, "b", "a", ["k", "id"], {}).collect())) == [("x", 1, "modify", "[[0]]", "[0]", "1", "2")] * 2
    assert D.told(rows.where("k = 'y'"), "b", "a", ["k"], {}).count() == 0
    for broken in ("[NaN]", "[1", ""):
        with pytest.raises(ValueError):
            D.read(broken)


def test_deep_and_large_documents():
    deep = lambda v: "[" * 300 + v + "]" * 300
    assert [x[0] for x in D.changes(D.read(deep("7")), D.read(deep("8")), {})] == ["modify"]
    side = lambda d: json.dumps({"a": [{"k": str(i), "v": i + d} for i in range(50000)]})
    assert len(D.changes(D.read(side(0)), D.read(side(1)), IDENTITY)) == 50000
    assert D.changes(D.read(side(0)), D.read(side(0)), IDENTITY) == []


@pytest.mark.parametrize("name", ["deep_document_diff", "change_summary_lines"])
def test_one_exchange_and_no_level(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Aggregate") == 1 and not any(x in plan for x in ("Generate", "parse_json", "Scan ExistingRDD", "Union"))
