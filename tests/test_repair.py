"""Repair in rounds, catalog and copies in columns, against the rewriting of open documents and by hand."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import form_columns as C, open_documents as O, repair as R

RULES = {
    "known": [O.FIELDS, O.KEY, O.TYPE, "mode", "style", "size", "name"],
    "allowed_keys": [O.FIELDS, O.KEY, O.TYPE, "mode", "style", "size", "name", "odd", "odder", "inner"],
    "types": {
        "1": {"name": "TEXT", "required": ["size"]},
        "2": {"name": "USER", "required": ["mode", "size"], "allowed": {"style": [1, 2]}},
        "3": {"name": "PLAIN_DATE", "allowed": {"style": ["x"], "mode": ["a", "b"]}},
        "4": {"name": "OPEN", "required": ["mode"], "allowed": {"style": []}},
    },
    "templates": {"1": {"size": {"inner": 1}}, "2": {"style": 9, "mode": "c"}},
    "defaults": {"2": {"mode": "b", "size": 3, "style": 2}, "4": {"mode": None}},
}


def form(rng):
    fields = []
    for k in rng.sample(range(30), rng.randrange(7)):
        f = {O.KEY: f"k{k}", O.TYPE: rng.choice([1, 2, 2, 3, "4", 5])}
        f |= {p: v for p, v in (("mode", rng.choice(["a", "b", "z", True])), ("style", rng.choice([1, 2, 7, "x", 2.5])), ("size", rng.choice([1, "s", [1, {"q": 2}]]))) if rng.random() < 0.5}
        f |= {"hidden": 1} if rng.random() < 0.3 else {}
        f |= {"odd": 1} if rng.random() < 0.1 else {}
        fields.append(f)
    doc = {"name": "n", O.FIELDS: fields, "kept": {"mode": None}}
    return doc | ({"odder": {"deep": 1}} if rng.random() < 0.2 else {})


def frame(spark, docs):
    text = lambda d: None if d is None else json.dumps(d)
    rows = spark.createDataFrame([(k, text(d), text(b)) for k, (d, b) in enumerate(docs)], "id int, d string, b string")
    return rows.select("id", F.parse_json("d").alias("d"), F.parse_json("b").alias("b"))


def words(x):
    """Booleans are told in JSON's words."""
    return [re.sub("=True ", "=true ", e) for e in x]


@pytest.fixture(scope="module")
def done(spark):
    rng = random.Random(31)
    docs = [(form(rng), rng.choice([None, form(rng)])) for _ in range(150)]
    docs = [(d, copy.deepcopy(d) if k % 5 == 0 else b) for k, (d, b) in enumerate(docs)]
    return docs, R.repaired(frame(spark, docs), "d", ["id"], RULES, "b")


def test_like_the_rewriting_of_open_documents(done):
    docs, got = done
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == len(docs)
    seen = []
    for k, (doc, base) in enumerate(docs):
        want = O.repaired(doc, RULES, base)
        assert json.loads(rows[k]["doc"]) == want["doc"], k
        assert rows[k]["errors"] == words(want["errors"]), k
        assert rows[k]["new_errors"] == words(want["new_errors"]), k
        assert rows[k]["rounds"] == want["rounds"], k
        seen.append((want["rounds"], want["doc"] != doc, len(want["new_errors"]) < len(want["errors"])))
    assert {s[0] for s in seen} == {1, 2, 3, 4} and {s[1] for s in seen} == {s[2] for s in seen} == {True, False}


def test_no_python_worker(done):
    assert not re.search("Python|Arrow|Pandas", done[1]._jdf.queryExecution().executedPlan().toString())


def test_nulls_repeated_keys_and_odd_documents(spark):
    f = lambda key, **more: {O.KEY: key, O.TYPE: 1, **more}
    docs = [
        None, [1], {}, {O.FIELDS: None}, {O.FIELDS: {"a": 1}}, {O.FIELDS: [1, None, []]}, 7,
        {O.FIELDS: [f("a", size=None), f("b")]},  # a null comes first for b, nothing for a but the template
        {O.FIELDS: [f("a", size=5), f("a"), f("")]},  # fields of one key are no siblings; one without a key cannot be named
        {O.FIELDS: [{O.KEY: "n"}, {O.TYPE: 1}]},
        {"a-b": 1}, {"odd": 1, "odder": 2},
        {f"z{i}": i for i in range(6)},
    ]
    rules = RULES | {"allowed_keys": RULES["allowed_keys"] + ["a-b"] + [f"z{i}" for i in range(6)]}
    got = {r["id"]: r for r in R.repaired(frame(spark, [(d, None) for d in docs]), "d", ["id"], rules, "b").collect()}
    assert len(got) == len(docs)
    for k in range(5):
        assert (got[k]["doc"] and json.loads(got[k]["doc"]), got[k]["errors"], got[k]["rounds"]) == (docs[k], [], 1)
    assert json.loads(got[5]["doc"]) == docs[5] and json.loads(got[6]["doc"]) == 7
    assert [x.get("size") for x in json.loads(got[7]["doc"])[O.FIELDS]] == [{"inner": 1}, {"inner": 1}] and got[7]["rounds"] == 4 and not got[7]["errors"]
    assert [x.get("size") for x in json.loads(got[8]["doc"])[O.FIELDS]] == [5, {"inner": 1}, None] and len(got[8]["errors"]) == 1
    assert len(got[9]["errors"]) == 1 and got[9]["rounds"] == 4
    assert (got[10]["errors"], got[10]["rounds"]) == (['Unrecognized field "a-b"'], 1)
    assert (got[11]["errors"], got[11]["rounds"]) == ([], 3)
    assert (got[12]["errors"], got[12]["rounds"]) == (['Unrecognized field "z3"'], 4)
    assert R.repaired(frame(spark, [(None, None)]).where("id > 5"), "d", ["id"], rules, "b").count() == 0


def test_values_are_those_before_the_round(spark):
    rules = RULES | {"types": {"2": {"name": "USER", "required": ["mode"], "allowed": {"mode": ["a", "b"]}}}, "templates": {}, "defaults": {}}
    doc = {O.FIELDS: [{O.KEY: "p", O.TYPE: 2, "mode": "z"}, {O.KEY: "q", O.TYPE: 2}]}
    got = R.repaired(frame(spark, [(doc, None)]), "d", ["id"], rules).first()
    assert [f["mode"] for f in json.loads(got["doc"])[O.FIELDS]] == ["a", "a"]
    assert (got["errors"], got["rounds"]) == ([], 3)  # q takes z first, which the second round mends


def test_a_form_with_very_many_fields_is_not_compared_in_pairs(spark):
    n = 20000
    doc = {O.FIELDS: [{O.KEY: f"k{i}", O.TYPE: 2, "mode": "a", **({"size": i} if i == n - 1 else {})} for i in range(n)]}
    got = R.repaired(frame(spark, [(doc, None)]), "d", ["id"], RULES).first()
    assert {f["size"] for f in json.loads(got["doc"])[O.FIELDS]} == {n - 1} and (got["errors"], got["rounds"]) == ([], 2)


def by_name(v):
    return {k: by_name(v[k]) for k in sorted(v)} if isinstance(v, dict) else [by_name(x) for x in v] if isinstance(v, list) else v


def test_catalog_and_copies(spark):
    option = {"optionFields": [{"optionLabel": "长" * 300, "optionValue": 1}], "b": "\"\n"}
    docs = [
        {O.FIELDS: [{O.KEY: "a", O.TITLE: "题", O.TYPE: 2, O.REQUIRED: True, O.OPTIONS: option}, {O.KEY: 5, O.TYPE: 9, O.REQUIRED: 0, "options": [1]}, {}], "formName": "\"名", "formState": 0, "topButtons": [{"buttonName": "返回"}, {}], "id": 3, "formCode": "c"},
        {O.FIELDS: [{O.KEY: "", O.REQUIRED: "", O.OPTIONS: {"optionFields": []}}], "bottomButtons": [{}], "createTime": 1},
        {"formTitle": None, "topButtons": None}, {O.FIELDS: None, "serverKey": {"b": [1], "a": 2}},
    ]
    rows = frame(spark, [(d, None) for d in docs] + [([1], None), (None, None)])
    got = {r["id"]: r for r in rows.select("id", C.catalog(F.col("d"), {"2": "SELECT"}).alias("c"), C.cloned(F.col("d"), F.lit(""), F.lit("new")).alias("x"), C.cloned(F.col("d"), F.lit(None), F.lit(None)).alias("y")).collect()}
    for k, d in enumerate(docs):
        want = O.catalog(by_name(d), {"2": "SELECT"})
        told = want["text"].replace('{"a": 2, "b": [1]}', '{"a":2,"b":[1]}')  # values of the form without spaces
        assert (got[k]["c"]["text"], got[k]["c"]["keys"]) == (told, want["keys"]), k
        assert json.loads(got[k]["x"]) == O.cloned(d, code="new") and json.loads(got[k]["y"]) == O.cloned(d)
    assert got[4]["c"] is got[5]["c"] is got[4]["x"] is got[5]["x"] is None
