"""Deep differences, summary lines, walks and schema keys against plain Python over documents of any shape."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import variants as V

MISSING = object()


def is_box(v):
    return isinstance(v, (dict, list))


def js_type(v):
    return "none" if v is MISSING else "object" if v is None or is_box(v) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"


def text(v):
    return "null" if v is None else json.dumps(v, separators=(",", ":"), sort_keys=True) if is_box(v) else str(v).lower() if isinstance(v, bool) else str(v)


def hint(path):
    out = []
    for seg in path.split("."):
        if "[" in seg:
            bare = re.sub(r"\[[^\]]*\]", "", seg)
            out.append(f"{bare}.*" if bare else "*")
        else:
            out.append("*" if re.fullmatch("[0-9]+", seg) else seg)
    return ".".join(s for s in out if s)


def walk(b, a, path, owner, identity, display, out):
    shown = lambda v: text(v[display]) if isinstance(v, dict) and display in v else None
    if js_type(b) != js_type(a) or b is None or a is None:
        if not (b is None and a is None) and not (b is MISSING and a is MISSING):
            out.append(("modify", path or "$", owner, b, a))
    elif isinstance(b, list) and isinstance(a, list):
        key = identity.get(hint(path), identity.get(path))
        at = lambda label: f"{path}[{label}]"
        if key is None:
            pairs = [(x, a[i] if i < len(a) else MISSING, f"[{i}]") for i, x in enumerate(b)]
            gone, new = [], [(x, f"[{len(b) + i}]") for i, x in enumerate(a[len(b) :])]
        else:
            of = lambda x: text(x[key]) if isinstance(x, dict) and key in x else None
            last = {of(x): x for x in a if of(x) is not None}
            pairs = [(x, last[of(x)], of(x)) for x in b if of(x) in last and of(x) is not None]
            gone = [(x, of(x)) for x in b if of(x) is not None and of(x) not in last]
            new = [(x, k) for k, x in last.items() if k not in {of(y) for y in b}]
        pick = lambda *vs: next((s for s in vs if s is not None), None)
        out += [("remove", at(k), pick(shown(x), owner), x, MISSING) for x, k in gone] + [("add", at(k), pick(shown(x), owner), MISSING, x) for x, k in new]
        for x, y, k in pairs:
            walk(x, y, at(k), pick(shown(x), shown(y), k), identity, display, out)
    elif is_box(b):
        as_dict = lambda v: {str(i): x for i, x in enumerate(v)} if isinstance(v, list) else v
        b, a = as_dict(b), as_dict(a)
        for k in sorted(b) + sorted(set(a) - set(b)):
            inner = f"{path}.{k}" if path else k
            if k not in b:
                out.append(("add", inner, owner, MISSING, a[k]))
            elif k not in a:
                out.append(("remove", inner, owner, b[k], MISSING))
            else:
                walk(b[k], a[k], inner, owner, identity, display, out)
    elif (float(b) != float(a)) if js_type(b) == "number" else b != a:
        out.append(("modify", path or "$", owner, b, a))


def anything(rng, depth):
    kind = rng.randrange(9) if depth else rng.randrange(5)
    if kind < 5:
        return [None, True, rng.randrange(3), rng.choice(["", "x", "1", "null"]), rng.choice([0.5, 2.5])][kind]
    if kind < 7:
        return {k: anything(rng, depth - 1) for k in rng.sample(["a", "b", "1", "items", "t"], rng.randrange(4))}
    return [({"k": rng.choice(["p", "q", 3, None]), "t": rng.choice(["T", "", 7])} if rng.random() < 0.5 else {}) | ({} if rng.random() < 0.3 else {"v": anything(rng, depth - 1)}) if rng.random() < 0.7 else anything(rng, depth - 1) for _ in range(rng.randrange(4))]


def changed(rng, v):
    if rng.random() < 0.25:
        return anything(rng, 2)
    if isinstance(v, dict):
        return {k: changed(rng, x) for k, x in v.items() if rng.random() < 0.85} | ({"new": 1} if rng.random() < 0.2 else {})
    return [changed(rng, x) for x in v if rng.random() < 0.85] + ([{"k": "q", "v": 1}] if rng.random() < 0.2 else []) if isinstance(v, list) else v


def shown(v):
    if v is MISSING or v is None:
        return "空"
    return "{…}" if is_box(v) else str(int(v)) if js_type(v) == "number" and float(v).is_integer() else text(v)


def lines(changes):
    changed_, out, by = [], [], {}
    for kind, path, owner, b, a in changes:
        thing = a if kind == "add" else b
        own = text(thing["t"]) if isinstance(thing, dict) and "t" in thing else None
        label = owner or own or re.split(r"[.\[]", re.sub(r"^\[|\]$", "", path))[0] or path
        if own == "" and not owner:
            label = own
        if kind == "modify":
            prop = path.split(".")[-1]
            by.setdefault(label, []).append(f"{prop} 变更" if MISSING in (b, a) else f"{prop}: {shown(b)} → {shown(a)}")
        else:
            out.append((1 if kind == "add" else 2, f"{'新增' if kind == 'add' else '删除'}「{label}」"))
    changed_ = [(0, f"修改「{k}」：{'；'.join(v[:3])}{' 等' if len(v) > 3 else ''}") for k, v in by.items()]
    return changed_ + [x for t in (1, 2) for x in out if x[0] == t]


@pytest.fixture(scope="module")
def compared(spark):
    rng = random.Random(21)
    docs = [(0, {"items": [{"k": "p", "t": "P", "v": {"items": [{"k": 1, "a": [1, [2, {"b": None}]]}]}}]}, {"items": [{"k": "p", "t": "P", "v": {"items": [{"k": 1, "a": [1, [2, {"b": 0}, 3]]}, {"k": 2}]}}]}), (1, [1, 2], {"0": 1, "2": 5}), (2, 1, 1.0), (3, None, None), (4, {}, []), (5, {"a": {str(i): i for i in range(6)}}, {"a": {str(i): i + 1 for i in range(6)}})]
    for k in range(6, 260):
        b = {x: anything(rng, 4) for x in ("items", "a", "b")} if k % 4 else anything(rng, 4)
        docs.append((k, b, changed(rng, b)))
    identity = {"items": "k", "items.*.v.items": "k", "a": "k", "*": "k"}
    rows = spark.createDataFrame([(k, json.dumps(b), json.dumps(a)) for k, b, a in docs] + [(1000, None, None), (1001, "[1]", None)], "id int, b string, a string")
    diff = V.deep_diff(rows.select("id", F.parse_json("b").alias("b"), F.parse_json("a").alias("a")), "b", "a", ["id"], identity, "t").cache()
    want = {}
    for k, b, a in docs + [(1000, MISSING, MISSING), (1001, [1], MISSING)]:
        walk(b, a, "", None, identity, "t", want.setdefault(k, []))
    return diff, want


def test_deep_diff_in_the_order_of_a_walk(compared):
    diff, want = compared
    got = {}
    for r in diff.withColumn("o", F.to_json("old")).withColumn("n", F.to_json("new")).orderBy("id", "at", F.to_json("old")).collect():
        got.setdefault(r["id"], []).append((r["kind"], r["path"], r["owner"], r["o"], r["n"]))
    plain = lambda v: None if v is MISSING else text(v) if not isinstance(v, str) else json.dumps(v)
    number = lambda s: None if s is None else re.sub(r"(\d)\.0\b", r"\1", s)
    assert sum(map(len, want.values())) > 500
    for k, changes in want.items():
        assert got.get(k, []) == [(c, p, o, number(plain(b)), number(plain(a))) for c, p, o, b, a in changes], k


def test_summary_lines(compared):
    diff, want = compared
    got = {}
    for r in V.change_lines(diff, ["id"], "t").orderBy("id", "turn", "at").collect():
        got.setdefault(r["id"], []).append((r["turn"], r["text"]))
    for k, changes in want.items():
        assert got.get(k, []) == lines(changes), k


def test_every_node_once(spark):
    rng = random.Random(22)
    docs = [anything(rng, 5) for _ in range(60)]

    def flat(v, path=()):
        yield path, v
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from flat(x, (*path, k if isinstance(v, dict) else f"[{k}]"))

    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(99, None)], "id int, j string").select("id", F.parse_json("j").alias("d"))
    got = sorted((r["id"], tuple(r["path"]), r["kind"]) for r in V.nodes(rows, "d", ["id"]).collect())
    kinds = lambda v: "null" if v is None else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else js_type(v)
    assert got == sorted((k, p, kinds(v)) for k, d in enumerate(docs) for p, v in flat(d))


def test_schema_keys_of_nested_and_odd_schemas(spark):
    def plain(node, out):
        if isinstance(node, dict):
            if isinstance(node.get("properties"), dict):
                out |= set(node["properties"])
            for v in node.values():
                plain(v, out)
        elif isinstance(node, list):
            for v in node:
                plain(v, out)
        return out

    schemas = [{"properties": {"a": {"properties": {"b": 1, "properties": {"c": {}}}}}, "x": [{"properties": {"d": 1}}, {"properties": ["e"]}]}, [], {"properties": None}, {"p": {"q": [[{"properties": {"r": {"items": {"properties": {"s": 0}}}}}]]}}]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(schemas)], "id int, j string").select("id", F.parse_json("j").alias("d"))
    got = {(r["id"], r["key"]) for r in V.schema_keys(rows, "d", ["id"]).collect()}
    assert got == {(k, x) for k, d in enumerate(schemas) for x in plain(d, set())}


def test_no_python_worker(compared):
    plan = compared[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rebuilt_documents(spark):
    rng = random.Random(23)
    docs = [anything(rng, 5) for _ in range(80)] + [{"a\"b\n": {"é": []}, "k": {}}, [{"k": 1, "v": [{"k": 1}, {"k": 1}]}, {"k": 1}, {"k": "1"}], [{"k": 1}, {"v": 1}, {"k": 1}], [[{"k": None}, {"k": None}]]]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "id int, j string").select("id", F.parse_json("j").alias("d"))
    tree = V.nodes(rows, "d", ["id"])
    again = lambda df: {r["id"]: json.loads(r["doc"]) for r in df.collect()}
    assert again(V.rebuilt(tree, ["id"])) == dict(enumerate(docs))

    def walk_up(v, visit):
        v = {k: walk_up(x, visit) for k, x in v.items()} if isinstance(v, dict) else [walk_up(x, visit) for x in v] if isinstance(v, list) else v
        return visit(v)

    def once(v):
        if isinstance(v, list) and v and all(isinstance(x, dict) and "k" in x for x in v):
            return [x for i, x in enumerate(v) if json.dumps(x["k"]) not in {json.dumps(y["k"]) for y in v[:i]}]
        return v

    assert again(V.rebuilt(tree, ["id"], "k")) == {i: walk_up(d, once) for i, d in enumerate(docs)}
    keep = lambda f: {i: walk_up(d, lambda v: {k: x for k, x in v.items() if f(k, x)} if isinstance(v, dict) else v) for i, d in enumerate(docs)}
    assert again(V.rebuilt(V.stripped(tree, ["k", "a"]), ["id"])) == keep(lambda k, x: k not in ("k", "a"))
    assert again(V.rebuilt(V.projected(tree, ["items", "v", "b"]), ["id"])) == keep(lambda k, x: k in ("items", "v", "b"))
    assert again(V.rebuilt(V.without_null_members(tree), ["id"])) == keep(lambda k, x: x is not None)
    assert again(V.rebuilt(V.numbers_for_booleans(tree), ["id"])) == {i: walk_up(d, lambda v: int(v) if isinstance(v, bool) else v) for i, d in enumerate(docs)}


def test_titles(spark):
    docs = [{"f": [{"k": "a"}]}, {"formTitle": "", "titleFieldKey": "t", "f": []}, {"formTitle": "x"}, {"formTitle": None, "f": [{"v": 1}]}, [1], {}]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "id int, j string").select("id", F.parse_json("j").alias("d"))
    got = {r["id"]: json.loads(r["doc"]) for r in V.rebuilt(V.titled(V.nodes(rows, "d", ["id"]), ["id"], "f", "k"), ["id"]).collect()}
    assert [got[k].get("formTitle") if isinstance(got[k], dict) else got[k] for k in range(6)] == ["$a$", "$t$", "x", "$name$", [1], "$name$"]


def test_deep_diff_in_one_pass(spark):
    """With a known depth all levels are one plan: nothing is stored between them, and the rows are those of the walk by levels."""
    rng = random.Random(24)
    docs = []
    for k in range(150):
        b = {x: anything(rng, 3) for x in ("items", "a", "b")}
        docs.append((k, json.dumps(b), json.dumps(changed(rng, b))))
    docs.append((150, *[json.dumps({"items": [{"k": k, "v": v} for k, v in side]}) for side in ([("p", 1), ("p", 2), ("q", 3)], [("q", 3), ("p", 1), ("p", 2)])]))
    docs.append((151, *[json.dumps({"items": [{"k": "p", "v": 1}, {"k": "p", "v": 2}]})] * 2))
    rows = spark.createDataFrame([*docs, (200, None, None)], "id int, b string, a string").select("id", F.parse_json("b").alias("b"), F.parse_json("a").alias("a"))
    diff = lambda deepest: V.deep_diff(rows, "b", "a", ["id"], {"items": "k", "a": "k", "*": "k"}, "t", deepest)
    told = lambda df: sorted(map(repr, df.select("id", "at", "kind", "path", "owner", F.to_json("old"), F.to_json("new")).collect()))
    whole = diff(7)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert told(whole) == told(diff(None)) and len(told(whole)) > 100
    with pytest.raises(Exception, match="deeper than was said"):
        diff(1).collect()
    assert V.change_lines(whole, ["id"], "t")._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1  # the changes are made once
