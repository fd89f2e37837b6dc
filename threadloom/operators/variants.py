"""Open documents (JSON of any shape) as rows of VARIANT values: walks and differences, one level at a time, in the JVM.

A level is one explode (and, for a difference, one aggregate that aligns the children of both sides); it is stored, and the next
begins from its containers. So a document of any depth costs one pass a level, and an array of any length is dealt out.
VARIANT keeps an object's keys in the order of their names, so that is the order here, too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.stored import stored

#: How an element of an array stands in a path.
PLACE = r"^\[[0-9]+\]$"


def members(v: Column) -> Column:
    """The members of an object as a map, else null."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """The elements of an array, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def kind(v: Column) -> Column:
    """object, array, null, string, boolean or number; null where there is no value at all."""
    scalar = F.schema_of_variant(v)
    named = F.when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").otherwise("number")
    return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(members(v).isNotNull(), "object").when(elements(v).isNotNull(), "array").otherwise(named)


def text_of(v: Column) -> Column:
    """A scalar as text; of an object or array its JSON, of null the word."""
    return F.when(F.is_variant_null(v), "null").otherwise(F.try_variant_get(v, "$", "string"))


def _child(label: Column, pos: Column, v: Column) -> Column:
    return F.struct(label.alias("label"), pos.cast("int").alias("pos"), v.alias("v"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kids(v: Column) -> Column:
    """The members or elements of a container; name is null for elements. Null for a scalar."""
    named = F.transform(F.map_entries(members(v)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v")))
    placed = F.transform(elements(v), lambda x: F.struct(F.lit(None).cast("string").alias("name"), x.alias("v")))
    return F.coalesce(named, placed)


def _too_deep(kids: Column) -> Column:
    return F.when(F.size(kids) > 0, F.raise_error(F.lit("a document is deeper than was said")))


def _in_row(v: Column, left: int, path: Column, parent: Column, name: Column, depth: int) -> Column:
    """An array with the node v and all below it, at most `left` levels."""

    def own(k: Column) -> Column:
        value = F.when(k["kind"].isin("string", "boolean", "number"), F.try_variant_get(v, "$", "string"))
        json = F.when(~k["kind"].isin("object", "array"), k["json"])
        return F.array(F.struct(path.alias("path"), F.lit(depth).alias("depth"), parent.alias("parent"), name.alias("name"), k["kind"].alias("kind"), value.alias("value"), json.alias("json")))

    def both(k: Column) -> Column:
        if not left:
            return F.when(_too_deep(k["kids"]).isNull(), own(k))
        step = lambda c, i: F.coalesce(c["name"], F.concat(F.lit("["), i.cast("string"), F.lit("]")))
        below = F.flatten(F.transform(k["kids"], lambda c, i: _in_row(c["v"], left - 1, F.concat(path, F.array(step(c, i))), k["kind"], c["name"], depth + 1)))
        return F.when(F.coalesce(F.size(k["kids"]), F.lit(0)) < 1, own(k)).otherwise(F.concat(own(k), below))

    # The kind is told by the children, else by the first letter of the JSON text; so each value is read once.
    def seen(k: Column) -> Column:
        full = F.coalesce(F.size(k), F.lit(0)) > 0
        return let(F.when(~full, F.to_json(v)), lambda t: F.struct(k.alias("kids"), t.alias("json"), F.when(full, F.when(F.get(k, F.lit(0))["name"].isNull(), "array").otherwise("object")).otherwise(F.coalesce(F.try_element_at(letters, F.substring(t, 1, 1)), F.lit("number"))).alias("kind")))

    letters = F.create_map(*[F.lit(x) for kv in {"{": "object", "[": "array", "n": "null", '"': "string", "t": "boolean", "f": "boolean"}.items() for x in kv])
    return let(let(_kids(v), seen), both)


def nodes(docs: DataFrame, doc: str, keys: list[str], deepest: int | None = None) -> DataFrame:
    """Every node of every document: `keys`, path (names, and places as [0]), depth, parent (the kind of the node above), name
    (null for elements), kind, value (of scalars, as text), json (of scalars and nulls).

    doc: a VARIANT column; documents without one give no rows. Keys need not be unique: rows stay apart where paths do.
    deepest: how many levels of containers the documents have at most, if that is known: they are then walked within their row, and a
    deeper one is an error. Else a level at a time, each stored."""
    there = docs.where(F.col(doc).isNotNull())
    if deepest is None:
        return _by_level(there, doc, keys)
    none = F.lit(None).cast("string")
    return there.select(*keys, F.inline(_in_row(F.col(doc), deepest, F.array().cast("array<string>"), none, none, 0)))


def _by_level(docs: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """The same for documents of any depth: a level is one explode, and is stored."""
    level = docs.where(F.col(doc).isNotNull()).select(*keys, F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.col(doc).alias("v"))
    out, depth = [], 0
    while True:
        level = stored(level.withColumn("kind", kind(F.col("v"))))
        value = F.when(~F.col("kind").isin("object", "array", "null"), text_of(F.col("v")))
        json = F.when(~F.col("kind").isin("object", "array"), F.to_json("v"))
        # The depth is a constant of each part, so a filter on it leaves the other parts out of the plan.
        out.append(level.select(*keys, "path", F.lit(depth).alias("depth"), "parent", "name", "kind", value.alias("value"), json.alias("json")))
        inner = level.where("kind in ('object', 'array')")
        if inner.isEmpty():
            break
        named = F.transform(F.map_entries(members(F.col("v"))), lambda e: F.struct(e["key"].alias("step"), e["key"].alias("name"), e["value"].alias("v")))
        placed = F.transform(elements(F.col("v")), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), F.lit(None).cast("string").alias("name"), x.alias("v")))
        each = inner.select(*keys, "path", F.col("kind").alias("parent"), F.explode(F.when(F.col("kind") == "object", named).otherwise(placed)).alias("c"))
        level = each.select(*keys, F.concat("path", F.array("c.step")).alias("path"), "parent", F.col("c.name").alias("name"), F.col("c.v").alias("v"))
        depth += 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def quoted(text: Column) -> Column:
    """A text as JSON."""
    boxed = F.to_json(F.array(text))  # quicker than by VARIANT, which makes a writer for each text
    return F.when(text.isNotNull(), F.substring(boxed, F.lit(2), F.length(boxed) - 2))


def rewritten(doc: Column, deepest: int, keep: Callable[[Column, Column], Column], scalar: Callable[[Column], Column] = F.to_json, unique: str | None = None) -> Column:
    """A VARIANT document as JSON text, put together in one walk: `rebuilt` for rules that see a node alone.

    keep: of a member's name and value, whether it stays, with all below it. scalar: the JSON text of a scalar, null or empty
    container. unique: in arrays of which every element is an object with that key, the first element of each value stays.
    deepest: how many levels of containers the document has at most; a deeper one is an error. Every level is a lambda in the last one's,
    so the analyzer's passes (100) end it between 6 and 9 levels; for more there are `nodes` and `rebuilt`."""
    text = _rewritten(doc, deepest, keep, scalar, unique)
    return text["t"] if unique else text


def _rewritten(v: Column, left: int, keep: Callable, scalar: Callable, unique: str | None) -> Column:
    none = F.lit(None).cast("string")
    result = lambda t, mark=none: F.struct(t.alias("t"), mark.alias("mark")) if unique else t
    text = lambda r: r["t"] if unique else r
    label = lambda c: F.coalesce(F.concat(quoted(c["name"]), F.lit(":")), F.lit(""))
    if not left:
        return let(_kids(v), lambda k: F.when(_too_deep(k).isNull(), result(scalar(v))))

    def firsts(made: Column) -> Column:
        by_mark = F.array_sort(F.transform(made, lambda m, i: F.struct(m["r"]["mark"].alias("mark"), i.alias("i"))))
        one_each = lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["mark"] != x["mark"]))
        kept = let(by_mark, one_each)
        return F.transform(F.array_sort(F.transform(kept, lambda x: x["i"])), lambda i: F.get(made, i))

    def closed(k: Column) -> Column:
        is_object = F.get(k, F.lit(0))["name"].isNotNull()
        join = lambda made: F.array_join(F.transform(made, lambda m: F.concat(m["label"], text(m["r"]))), ",")
        inner = lambda c: F.struct(label(c).alias("label"), _rewritten(c["v"], left - 1, keep, scalar, unique).alias("r"))
        box = lambda t: F.when(is_object, F.concat(F.lit("{"), t, F.lit("}"))).otherwise(F.concat(F.lit("["), t, F.lit("]")))
        made = F.transform(F.filter(k, lambda c: c["name"].isNull() | F.coalesce(keep(c["name"], c["v"]), F.lit(False))), inner)
        if not unique:
            return box(join(made))
        key = f'"{unique}":'
        mark = lambda m: F.when(is_object, F.get(F.filter(m, lambda x: x["label"] == key), F.lit(0))["r"]["t"])
        all_marked = lambda m: ~is_object & F.forall(m, lambda x: x["r"]["mark"].isNotNull())
        return let(made, lambda m: result(box(join(F.when(all_marked(m), firsts(m)).otherwise(m))), mark(m)))

    return let(_kids(v), lambda k: F.when(F.coalesce(F.size(k), F.lit(0)) < 1, result(scalar(v))).otherwise(closed(k)))


def rebuilt(tree: DataFrame, keys: list[str], unique: str | None = None) -> DataFrame:
    """(`keys`, doc): the documents that nodes make up, as JSON text, from the deepest level up.

    Nodes may have been left out or changed; what lies below a node that is not there goes with it. unique: in arrays of which
    every element is an object with that key, the first element of each value stays. A level is one aggregate; an array's
    elements meet in one row, as they do in the document."""
    deepest = tree.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        own = tree.where(F.col("depth") == depth).select(*keys, "path", "parent", "name", "kind", "json")
        own = own.join(below, [*keys, "path"], "left") if below is not None else own.withColumn("inner", F.lit(None).cast("string")).withColumn("mark", F.lit(None).cast("string"))
        empty = F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]")
        own = own.withColumn("json", F.coalesce(F.when(empty.isNotNull(), F.coalesce("inner", empty)), "json"))
        if not depth:
            return own.select(*keys, F.col("json").alias("doc"))
        index = F.regexp_extract(F.element_at("path", -1), "[0-9]+", 0)
        child = own.select(*keys, F.expr("slice(path, 1, size(path) - 1)").alias("path"), "parent", "name", "json", F.when(F.col("kind") == "object", F.col("mark")).alias("mark"), F.when(F.col("parent") == "array", index.cast("int")).alias("i"))
        if unique:
            again = F.row_number().over(Window.partitionBy(*keys, "path", "mark").orderBy("i"))
            child = child.withColumn("again", (F.col("parent") == "array") & F.col("mark").isNotNull() & (again > 1))
        else:
            child = child.withColumn("again", F.lit(False))
        listed = F.array_sort(F.collect_list(F.struct("i", "name", "again", F.when(F.col("parent") == "object", F.concat(quoted(F.col("name")), F.lit(":"), "json")).otherwise(F.col("json")).alias("text"))))
        met = child.groupBy(*keys, "path").agg(F.first("parent").alias("parent"), listed.alias("l"), (F.count("mark") == F.count(F.lit(1))).alias("marked"), F.max(F.when(F.col("name") == unique, F.col("json")) if unique else F.lit(None).cast("string")).alias("mark"))
        kept = F.when(F.col("marked"), F.filter("l", lambda x: ~x["again"])).otherwise(F.col("l"))
        text = F.array_join(F.transform(kept, lambda x: x["text"]), ",")
        box = F.when(F.col("parent") == "object", F.concat(F.lit("{"), text, F.lit("}"))).otherwise(F.concat(F.lit("["), text, F.lit("]")))
        below = stored(met.select(*keys, "path", box.alias("inner"), "mark"))


def projected(tree: DataFrame, allowed: list[str]) -> DataFrame:
    """J-06: only allowed keys, at every level."""
    return tree.where(F.forall("path", lambda p: p.isin(allowed) | p.rlike(PLACE)))


def stripped(tree: DataFrame, names: list[str]) -> DataFrame:
    """J-07: without some keys, at every level."""
    return tree.where(~F.arrays_overlap("path", F.array(*map(F.lit, names))))


def without_null_members(tree: DataFrame) -> DataFrame:
    """J-04: object members that are null go; null elements stay."""
    return tree.where(F.col("name").isNull() | (F.col("kind") != "null"))


def numbers_for_booleans(tree: DataFrame) -> DataFrame:
    """J-02: 1 and 0 for true and false."""
    number = F.when(F.col("value") == "true", "1").otherwise("0")
    return tree.withColumn("json", F.when(F.col("kind") == "boolean", number).otherwise(F.col("json"))).withColumn("kind", F.when(F.col("kind") == "boolean", "number").otherwise(F.col("kind")))


def titled_value(doc: Column, fields: str, key: str) -> Column:
    """`titled` on a VARIANT document."""
    told = lambda path: F.nullif(F.when(~kind(F.try_variant_get(doc, path, "variant")).isin("object", "array", "null"), F.try_variant_get(doc, path, "string")), F.lit(""))
    first = F.try_variant_get(doc, f"$.{fields}[0].{key}", "variant")
    first = F.when(~kind(first).isin("object", "array", "null"), text_of(first))
    title = F.concat(F.lit("$"), F.coalesce(told("$.titleFieldKey"), first, F.lit("name")), F.lit("$"))
    rest = F.map_filter(members(doc), lambda k, v: k != "formTitle")
    new = F.to_variant_object(F.map_concat(rest, F.create_map(F.lit("formTitle"), title.cast("variant"))))
    return F.when(members(doc).isNotNull() & told("$.formTitle").isNull(), new).otherwise(doc)


def titled(tree: DataFrame, keys: list[str], fields: str, key: str) -> DataFrame:
    """I-18, J-05: documents without a title get $key$ of their titleFieldKey, else of their first field, else $name$."""
    at = lambda *path: F.max(F.when(F.col("path") == F.array(*map(F.lit, path)), F.col("value")))
    said = lambda c: F.nullif(c, F.lit(""))
    told = tree.groupBy(*keys).agg(at("formTitle").alias("title"), at("titleFieldKey").alias("named"), at(fields, "[0]", key).alias("first"), F.bool_or((F.col("depth") == 0) & (F.col("kind") == "object")).alias("open"))
    value = F.concat(F.lit("$"), F.coalesce(said(F.col("named")), F.col("first"), F.lit("name")), F.lit("$"))
    new = told.where(F.col("open") & said(F.col("title")).isNull()).select(*keys, F.array(F.lit("formTitle")).alias("path"), F.lit(1).alias("depth"), F.lit("object").alias("parent"), F.lit("formTitle").alias("name"), F.lit("string").alias("kind"), value.alias("value"), quoted(value).alias("json"))
    kept = tree.where((F.col("path") != F.array(F.lit("formTitle"))) | (F.coalesce(F.col("value"), F.lit("")) != ""))
    return kept.unionByName(new)


def schema_keys(docs: DataFrame, doc: str, keys: list[str], deepest: int | None = None) -> DataFrame:
    """E-08, H-07: (`keys`, key, n): the names that any `properties` object of a schema declares, however deep, and how often."""
    declared = nodes(docs, doc, keys, deepest).where((F.col("parent") == "object") & (F.try_element_at("path", F.lit(-2)) == "properties"))
    return declared.groupBy(*keys, F.col("name").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def hint_path(path: Column) -> Column:
    """A path with every array label as `*`, the form in which identities are declared."""
    stripped = lambda s: F.regexp_replace(s, r"\[[^\]]*\]", "")
    one = lambda s: F.when(F.contains(s, F.lit("[")), F.when(stripped(s) != "", F.concat(stripped(s), F.lit(".*"))).otherwise("*")).when(s.rlike("^[0-9]+$"), "*").otherwise(s)
    return F.array_join(F.filter(F.transform(F.split(path, r"\."), one), lambda s: s != ""), ".")


def _shown(v: Column, display: str | None) -> Column:
    """The name that an object shows itself by, if it has the key."""
    return text_of(F.try_element_at(members(v), F.lit(display))) if display else F.lit(None).cast("string")


def _member_text(v: Column, name: str) -> Column:
    """A member of an object as text; null for what has none."""
    if set(name) & set("\"\\"):
        return text_of(F.try_element_at(members(v), F.lit(name)))
    return text_of(F.try_variant_get(v, f'$["{name}"]', "variant"))


def _judged(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of values: change is `walk` where both are containers, `modify` where they differ, null where they are the same.

    Each value is written out once; its kind is told by the first letter. What reads the same and holds no array, whose elements may share
    an identity, is the same."""
    pairs = pairs.select("*", F.to_json("b").alias("jb"), F.to_json("a").alias("ja"))
    letters = F.create_map(*[F.lit(x) for kv in {"{": "object", "[": "array", "n": "null", "t": "boolean", "f": "boolean"}.items() for x in kv])
    told = lambda j, v: F.when(F.substring(j, 1, 1) == '"', F.when(F.schema_of_variant(v) == "STRING", "string").otherwise("number")).otherwise(F.coalesce(F.try_element_at(letters, F.substring(j, 1, 1)), F.when(j.isNotNull(), F.lit("number"))))
    pairs = pairs.select("*", told(F.col("jb"), F.col("b")).alias("kb"), told(F.col("ja"), F.col("a")).alias("ka"))
    boxed = F.col("kb").isin("object", "array") & F.col("ka").isin("object", "array")
    same_text = (F.col("jb") == F.col("ja")) & ~F.contains("jb", F.lit("["))
    number = lambda v: F.try_variant_get(v, "$", "double")
    same = F.when(F.col("kb") != F.col("ka"), False).when(F.col("kb") == "number", number(F.col("b")) == number(F.col("a"))).otherwise(F.col("jb") == F.col("ja"))
    change = F.when(F.col("change") != "walk", F.col("change")).when(boxed & same_text, None).when(boxed, "walk").when(~F.coalesce(same, F.col("kb").isNull() & F.col("ka").isNull()), "modify")
    # A last pair of empty containers has nothing below it.
    bare = F.coalesce(F.col("jb").isin("{}", "[]") & F.col("ja").isin("{}", "[]"), F.lit(False))
    return pairs.select(*keys, "at", "path", "owner", change.alias("change"), "kb", "ka", "b", "a", bare.alias("bare"))


def _pairs(identities: list[str]) -> Column:
    """What lies below a pair of containers: an array of (label, o, p, b, a), o the old one's place, p that of the first new one.

    Where both sides have the same labels they are taken as they stand; else the labels of both are sorted together and cut where they
    change, so nothing is compared in pairs."""
    by = lambda e, k: F.when(F.col("key") == k, F.transform(e, lambda x: _member_text(x, k)))
    keyed = lambda e: F.coalesce(*[by(e, k) for k in identities], F.lit(None).cast("array<string>"))
    placed = lambda e: F.transform(e, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("]")))
    as_keys = lambda e: F.transform(e, lambda x, i: i.cast("string"))
    names = lambda e: F.when(F.col("mode") == "keyed", keyed(e)).when(F.col("mode") == "placed", placed(e)).otherwise(as_keys(e))
    box = lambda n, v: F.struct(n.alias("n"), v.alias("v"))
    side = lambda v, k: F.when(F.col(k) == "object", let(members(F.col(v)), lambda m: box(F.map_keys(m), F.map_values(m)))).otherwise(let(elements(F.col(v)), lambda e: box(names(e), e)))
    mark = lambda n, s: F.transform(n, lambda x, i: F.struct(x.alias("label"), F.lit(s).alias("s"), (i if s else -i).alias("p")))

    def group(g: Column, b: Column, a: Column) -> Column:
        """Of one label: the new ones, the last of them first, then the old ones."""
        head = F.get(g, F.lit(0))
        last = F.when(head["s"] == 0, F.get(a, -head["p"]))
        one = lambda o, p, v: F.struct(head["label"].alias("label"), o.cast("int").alias("o"), p.cast("int").alias("p"), v.alias("b"), last.alias("a"))
        none = F.lit(None)
        first = F.get(F.filter(g, lambda x: x["s"] == 0), F.size(g) - 1)["p"]
        return F.when(F.element_at(g, -1)["s"] == 0, F.array(one(none, -first, none.cast("variant")))).otherwise(F.transform(F.filter(g, lambda x: x["s"] == 1), lambda x: one(x["p"], none, F.get(b, x["p"]))))

    def met(x: Column) -> Column:
        b, a = x["b"]["v"], x["a"]["v"]
        order = F.sort_array(F.filter(F.concat(mark(x["a"]["n"], 0), mark(x["b"]["n"], 1)), lambda m: m["label"].isNotNull()))

        def cut(s: Column) -> Column:
            starts = F.filter(F.transform(s, lambda m, i: i), lambda i: (i == 0) | (F.get(s, i - 1)["label"] != F.get(s, i)["label"]))
            return let(starts, lambda st: F.flatten(F.transform(st, lambda i, k: let(F.slice(s, i + 1, F.coalesce(F.get(st, k + 1), F.size(s)) - i), lambda g: group(g, b, a)))))

        names_ = x["b"]["n"]
        alike = (names_ == x["a"]["n"]) & ((F.col("mode") != "keyed") | (F.size(F.array_distinct(F.array_compact(names_))) == F.size(names_)))
        straight = F.transform(names_, lambda n, i: F.struct(n.alias("label"), i.alias("o"), F.lit(None).cast("int").alias("p"), F.get(b, i).alias("b"), F.get(a, i).alias("a")))
        return F.when(alike, straight).otherwise(let(order, cut))

    return let(F.struct(side("b", "kb").alias("b"), side("a", "ka").alias("a")), met)


def _below(level: DataFrame, keys: list[str], identity: dict[str, str], display: str | None) -> DataFrame:
    """The pairs below each `walk`, judged; other changes stay as they are."""
    hints = F.create_map(*[F.lit(x) for kv in (identity or {"": ""}).items() for x in kv])
    arrays = (F.col("kb") == "array") & (F.col("ka") == "array")
    key = F.when((F.col("change") == "walk") & arrays, F.coalesce(F.try_element_at(hints, hint_path(F.col("path"))), F.try_element_at(hints, F.col("path"))))
    ways = level.withColumn("key", key).withColumn("mode", F.when(~arrays, "object").when(F.col("key").isNotNull(), "keyed").otherwise("placed"))
    none = lambda kind: F.lit(None).cast(kind)
    self_ = F.struct(none("string").alias("label"), none("int").alias("o"), none("int").alias("p"), F.col("b"), F.col("a"))
    made = F.when(F.col("change") == "walk", _pairs(sorted(set(identity.values())))).when(F.col("change").isNotNull(), F.array(self_))
    each = ways.select(*keys, "at", "path", "owner", "mode", F.col("change").alias("was"), F.inline(made))
    inner, new, gone = F.col("was") == "walk", F.col("o").isNull(), F.col("a").isNull()
    placed, keyed = F.col("mode") == "placed", F.col("mode") == "keyed"
    change = F.when(~inner, F.col("was")).when(new, "add").when(gone & ~placed, "remove").otherwise("walk")
    # Removals, additions and pairs of an array one after the other; of an object the old keys, then the new ones.
    turn = F.when(new, 1).when(~gone & (placed | keyed) | gone & placed, 2).otherwise(0)
    at = F.when(inner, F.concat("at", F.array((turn * (1 << 28) + F.coalesce("o", "p")).cast("int")))).otherwise(F.col("at"))
    path = F.when(~inner, F.col("path")).when(placed | keyed, F.concat("path", F.lit("["), "label", F.lit("]"))).when(F.col("path") == "", F.col("label")).otherwise(F.concat_ws(".", "path", "label"))
    shown = lambda v: _member_text(F.col(v), display) if display else none("string")
    owner = F.when(~inner | ~(placed | keyed), F.col("owner")).when(new, F.coalesce(shown("a"), F.col("owner"))).when(gone & ~placed, F.coalesce(shown("b"), F.col("owner"))).otherwise(F.coalesce(shown("b"), shown("a"), F.col("label")))
    return _judged(each.select(*keys, at.alias("at"), path.alias("path"), owner.alias("owner"), change.alias("change"), "b", "a"), keys)


def deep_diff(docs: DataFrame, before: str, after: str, keys: list[str], identity: dict[str, str] | None = None, display: str | None = None, deepest: int | None = None) -> DataFrame:
    """J-19: what changed between two VARIANT documents: `keys`, at, kind (add, remove, modify), path, owner, old, new (VARIANT).

    Objects are aligned by key; arrays whose path (labels as `*`) is in `identity` by that key of their elements, others by
    place, where old elements without a new one are modified to nothing. Elements without the identity key are left out; of new
    elements with one key the last counts; old ones with one key are each compared. Only what is highest is told: an added or
    removed subtree is one row. owner: the display name, or else the label, of the array element that a change lies in; an
    added or removed element is its own, if it has a name. Values of two types are modified as a whole, but an array and an
    object are compared key by key; numbers are compared as doubles. at: rows of a document in this order are in the order of a
    walk (of an array removals, then additions, then pairs). Two missing documents give nothing; keys must be unique.
    deepest: how many levels of containers both documents have in common at most, if that is known: all levels are then one pass, nothing is
    stored, and deeper ones are an error. Else each level is stored."""
    first = docs.select(*keys, F.array().cast("array<int>").alias("at"), F.lit("").alias("path"), F.lit(None).cast("string").alias("owner"), F.lit("walk").alias("change"), F.col(before).alias("b"), F.col(after).alias("a"))
    level, told = _judged(first, keys), F.when(F.col("path") == "", "$").otherwise(F.col("path"))
    as_told = lambda rows: rows.select(*keys, "at", F.col("change").alias("kind"), told.alias("path"), "owner", F.col("b").alias("old"), F.col("a").alias("new"))
    if deepest is not None:
        for _ in range(deepest):
            level = _below(level, keys, identity or {}, display)
        deeper = F.when(~F.col("bare"), F.raise_error(F.lit("a document is deeper than was said")))
        return as_told(level.withColumn("change", F.when(F.col("change") == "walk", deeper.cast("string")).otherwise(F.col("change"))).where("change is not null"))
    level, out = stored(level.where("change is not null")), []
    while True:
        out.append(as_told(level.where("change <> 'walk'")))
        open_ = level.where("change = 'walk'")
        if open_.isEmpty():
            break
        level = stored(_below(open_, keys, identity or {}, display).where("change is not null"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def shown_value(v: Column) -> Column:
    """A value in a summary line: 空 for nothing, {…} for a container, else the value; whole numbers without a point."""
    number = F.try_variant_get(v, "$", "double")
    plain = F.when((kind(v) == "number") & (number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("long").cast("string")).otherwise(text_of(v))
    return F.when(v.isNull() | F.is_variant_null(v), "空").when(kind(v).isin("object", "array"), "{…}").otherwise(plain)


def change_lines(changes: DataFrame, keys: list[str], item_label: str = "name") -> DataFrame:
    """J-20, E-05, E-06: (`keys`, line, text): a line per owner with its first three modifications, then added, then removed things.

    A thing is named by its owner, else by its own label, else by the first part of its path."""
    thing = F.when(F.col("kind") == "add", F.col("new")).otherwise(F.col("old"))
    head = F.element_at(F.split(F.regexp_replace("path", r"^\[|\]$", ""), r"[.\[]"), 1)
    label = F.coalesce(F.nullif(F.col("owner"), F.lit("")), _shown(thing, item_label), F.nullif(head, F.lit("")), F.col("path"))
    prop = F.element_at(F.split("path", r"\."), -1)
    said = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.concat(prop, F.lit(": "), shown_value(F.col("old")), F.lit(" → "), shown_value(F.col("new")))).otherwise(F.concat(prop, F.lit(" 变更")))
    named = changes.select(*keys, "at", "kind", label.alias("label"), F.when(F.col("kind") == "modify", said).alias("said"))
    # One aggregate for all, so that the changes are made once: modifications meet by label, other changes stay apart by place.
    modified, turn = F.col("kind") == "modify", F.when(F.col("kind") == "modify", 0).when(F.col("kind") == "add", 1).otherwise(2)
    listed = F.sort_array(F.collect_list(F.struct("at", "said")))
    first = F.concat(F.array_join(F.transform(F.slice(listed, 1, 3), lambda x: x["said"]), "；"), F.when(F.count(F.lit(1)) > 3, " 等").otherwise(""))
    met = named.groupBy(*keys, turn.alias("turn"), "label", F.when(~modified, F.col("at")).alias("place")).agg(F.min("at").alias("at"), first.alias("said"))
    verb = F.when(F.col("turn") == 1, "新增「").otherwise("删除「")
    text = F.when(F.col("turn") == 0, F.concat(F.lit("修改「"), "label", F.lit("」："), "said")).otherwise(F.concat(verb, "label", F.lit("」")))
    return met.select(*keys, "turn", "at", text.alias("text"))
