"""The fold of typed ops against the rewriting of open documents: random batches, every kind of failure."""

import random

from threadloom.operators import op_fold as P, open_documents as O

TEMPLATES = {9: {"w": "t", "fieldDefaultValue": "d"}}


def batch(rng):
    key = lambda: rng.choice(["a", "b", "c", "new", "nope", "", None])
    title = lambda: rng.choice(["A", "B", "none", "", None])
    patch = lambda: rng.choice([None, {}, {"w": "9"}, {"w": "1", "x": "2"}, {O.KEY: "a"}, {O.KEY: "z", "w": "5"}, {O.TITLE: "T"}, {"formState": "1"}, {"formName": "n", "owner": "o", "id": "i"}])
    out = []
    for _ in range(rng.randrange(5)):
        kind = rng.choice(["update_field", "update_field", "add_field", "add_field", "remove_field", "update_form", "update_button", "full_rewrite" if rng.random() < 0.3 else "update_field", "odd" if rng.random() < 0.3 else "remove_field"])
        field = rng.choice([None, {"key": key(), "title": title(), "type": rng.choice([1, 2, 3, 9]), "values": rng.choice([None, {"w": "7"}, {"y": "8"}])}])
        out.append({"op": kind, "key": key(), "title": title(), "patch": patch(), "field": field, "after": rng.choice([None, "", key()]), "before": rng.choice([None, key()]), "anchor_title": title(), "name": rng.choice(["save", "back", "none", None])})
    return out


def form(rng):
    fields = [{"key": k, "title": k.upper(), "type": rng.choice([1, 2]), "values": {"w": str(rng.randrange(9)), "fieldDefaultValue": "q"}} for k in rng.sample(["a", "b", "c"], rng.randrange(1, 4))]
    buttons = [{"part": p, "name": n, "values": {"t": "x"}} for p, n in (("topButtons", "back"), ("bottomButtons", "save"), ("bottomButtons", "back"))]
    return {"fields": fields, "form": {"formName": "f"}, "buttons": buttons[rng.randrange(2) :]}


def as_document(f):
    doc = dict(f["form"]) | {O.FIELDS: [{O.KEY: x["key"], O.TITLE: x["title"], O.TYPE: x["type"]} | x["values"] for x in f["fields"]]}
    for b in f["buttons"]:
        doc.setdefault(b["part"], []).append({"buttonName": b["name"]} | b["values"])
    return doc


def as_op(o):
    field = o["field"] and {O.KEY: o["field"]["key"], O.TITLE: o["field"]["title"], O.TYPE: o["field"]["type"]} | (o["field"]["values"] or {})
    return {k: v for k, v in o.items() if k != "field"} | {"field": field, "name": o["name"] if o["name"] is not None else ""}


def test_batches_are_those_of_open_documents(spark):
    rng = random.Random(51)
    rows = [{"id": k, "ops": batch(rng)} | form(rng) for k in range(900)]
    schema = f"id int, ops array<{P.OP}>, fields array<{P.FIELD}>, form map<string,string>, buttons array<{P.BUTTON}>"
    got = {r["id"]: r.asDict(recursive=True) for r in P.apply_ops(spark.createDataFrame(rows, schema), TEMPLATES).collect()}
    seen = {"ok": 0, "failures": 0, "full_rewrite": 0}
    for row in rows:
        want, r = O.apply_ops(as_document(row), [as_op(o) for o in row["ops"]], {str(k): v for k, v in TEMPLATES.items()}), got[row["id"]]
        assert (r["ok"], r["full_rewrite"], r["failures"]) == (want["ok"], want["full_rewrite"], want["failures"]), row
        assert as_document(r) == want["doc"], row
        assert (r["touched"], sorted(r["touched_form"]), r["notes"]) == (want["touched"], sorted(want["touched_form"]), want["notes"]), row
        for k in seen:
            seen[k] += bool(r[k])
    assert min(seen.values()) > 40


def test_no_python_worker(spark):
    rows = spark.createDataFrame([], f"ops array<{P.OP}>, fields array<{P.FIELD}>, form map<string,string>, buttons array<{P.BUTTON}>")
    plan = P.apply_ops(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
