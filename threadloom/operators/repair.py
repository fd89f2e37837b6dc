"""Validate and mend open form documents in rounds, no Python worker.

A document of few fields and levels goes through all its rounds within its row. For the others a round is one aggregate that gathers a
document's messages, and, for documents that have messages which name what to mend, joins of the wanted properties with the fields of the
same document: their fields are rows, so that no large document's fields are compared in pairs. Rules, templates and defaults are parameters;
they are literals of the plan, not joined."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import INVALID_VALUE, MISSING_VALUE, UNKNOWN_FIELD
from ..sources.stored import stored
from . import open_documents as O
from .form_columns import at
from .variants import PLACE, _kids, elements, let, members, nodes, projected, quoted, text_of

#: (field key, property, allowed values or null), as messages name them.
WANTED = "array<struct<key:string,prop:string,allowed:array<string>>>"

#: Documents of at most so many fields and levels of containers are mended within their row.
ROW_FIELDS, ROW_LEVELS = 64, 5
_FIELD = "struct<key:string,code:string,m:map<string,variant>>"
_STRANGE = "array<struct<depth:int,path:array<string>,name:string>>"
_VALUES = "array<struct<pos:int,prop:string,json:string>>"
_STATE = f"struct<fields:array<{_FIELD}>,strange:{_STRANGE},gone:array<string>,errors:array<string>,rounds:int,set:boolean>"


def fields_of(docs: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """(`keys`, pos, key, code, v, m): the fields of each document; m: the members of those that are objects."""
    each = docs.select(*keys, F.posexplode(elements(at(F.col(doc), O.FIELDS))).alias("pos", "v"))
    return each.select(*keys, "pos", text_of(at(F.col("v"), O.KEY)).alias("key"), text_of(at(F.col("v"), O.TYPE)).alias("code"), "v", members(F.col("v")).alias("m"))


def _by_code(types: dict[str, Any], part: str, kind: str, code: Column) -> Column:
    """What the rules of a field's type say, from a literal map."""
    entries = [x for c, rule in types.items() if rule.get(part) for x in (F.lit(c), _literal(rule[part]))]
    return F.try_element_at(F.create_map(*entries), code) if entries else F.lit(None).cast(kind)


def _literal(value: Any) -> Column:
    if isinstance(value, dict):
        return F.array(*[F.struct(F.lit(k).alias("prop"), F.array(*[F.lit(str(x)) for x in v]).alias("allowed")) for k, v in value.items()])
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def complaints(rules: dict, field: Callable[[str], Column] = F.col) -> Column:
    """The messages on a field (key, code, m): its type's required properties that it lacks, then values that are not allowed."""
    types, code = rules["types"], field("code")
    name = F.coalesce(_by_code(types, "name", "string", code), F.lit(""))
    value = lambda prop: (lambda v: F.when(~F.is_variant_null(v), text_of(v)))(F.try_element_at(field("m"), prop))
    key = F.coalesce(field("key"), F.lit("None"))
    lacking = F.filter(_by_code(types, "required", "array<string>", code), lambda p: value(p).isNull())
    lacking = F.transform(lacking, lambda p: F.concat(F.lit("D: "), key, F.lit("."), p, F.lit(" 为必填项(字段类型="), name, F.lit(")")))
    odd = F.filter(_by_code(types, "allowed", "array<struct<prop:string,allowed:array<string>>>", code), lambda r: value(r["prop"]).isNotNull() & ~F.array_contains(r["allowed"], value(r["prop"])))
    odd = F.transform(odd, lambda r: F.concat(F.lit("D: "), key, F.lit("."), r["prop"], F.lit("="), value(r["prop"]), F.lit(" 不合法,类型"), name, F.lit(" 允许值=["), F.array_join(r["allowed"], ","), F.lit("]")))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(lacking, none), F.coalesce(odd, none))


def unknown_names(message: Column) -> Column:
    """I-19: the names that a message calls unknown."""
    return F.when(F.contains(message, F.lit("Unrecognized")), F.regexp_extract_all(message, F.lit(UNKNOWN_FIELD), F.lit(1))).otherwise(F.array().cast("array<string>"))


def wanted_of(message: Column) -> Column:
    """I-20, I-21: what a message wants mended: values that are not allowed, then values that are missing."""
    group = lambda pattern, n: F.regexp_extract_all(message, F.lit(pattern), F.lit(n))
    listed = lambda text: F.filter(F.transform(F.split(text, ","), F.trim), lambda v: v != "")
    odd = F.transform(F.arrays_zip(group(INVALID_VALUE, 1).alias("k"), group(INVALID_VALUE, 2).alias("p"), group(INVALID_VALUE, 4).alias("a")), lambda x: F.struct(x["k"].alias("key"), x["p"].alias("prop"), listed(x["a"]).alias("allowed")))
    lacking = F.transform(F.arrays_zip(group(MISSING_VALUE, 1).alias("k"), group(MISSING_VALUE, 2).alias("p")), lambda x: F.struct(x["k"].alias("key"), x["p"].alias("prop"), F.lit(None).cast("array<string>").alias("allowed")))
    said = lambda text, found: F.when(F.contains(message, F.lit(text)), found.cast(WANTED)).otherwise(F.array().cast(WANTED))  # noqa: E731  most messages are of one kind
    return F.concat(said("允许值=", odd), said("为必填项", lacking))


def _given(values: dict[str, dict] | None, code: Column, prop: Column) -> Column:
    """The JSON text that a table of values by type code and property has for (code, prop)."""
    entries = [x for c, of in (values or {}).items() for p, v in of.items() for x in (F.lit(f"{c}\n{p}"), F.lit(json.dumps(v, ensure_ascii=False, separators=(",", ":"))))]
    return F.try_element_at(F.create_map(*entries), F.concat(code, F.lit("\n"), prop)) if entries else F.lit(None).cast("string")


def _permitted(allowed: Column, v: Column) -> Column:
    return allowed.isNull() | F.coalesce(F.array_contains(allowed, text_of(v)), F.lit(False))


def _own_value(code: Column, prop: Column, allowed: Column, templates: dict[str, dict] | None, defaults: dict[str, dict] | None) -> Column:
    """The JSON text of what a property is set to where no other field has a value: template, default, first allowed value."""
    fit = lambda text: F.when(_permitted(allowed, F.try_parse_json(text)), text)
    first = F.get(allowed, F.lit(0))
    last_resort = F.when(first.rlike(r"^-?[0-9]+$"), F.to_json(F.try_parse_json(first))).when(first.isNotNull(), quoted(first))
    return F.coalesce(fit(_given(templates, code, prop)), fit(_given(defaults, code, prop)), last_resort)


def mends(wanted: DataFrame, fields: DataFrame, keys: list[str], templates: dict[str, dict] | None = None, defaults: dict[str, dict] | None = None) -> DataFrame:
    """D-09, D-10, J-08, (`keys`, pos, prop, json): the values to set.

    wanted: (`keys`, key, prop, allowed). A value comes from the first other field of the type that has the property, the type's
    template, its defaults, the first allowed value, whichever first has one that is allowed; all are read as they were before
    the round. A null that is found first means that nothing is set. Of fields that share a key the last is mended; keys that no
    field has and fields without a type are left."""
    owners = fields.where("key <> '' and code is not null").groupBy(*keys, "key").agg(F.max_by(F.struct("pos", "code", "m"), "pos").alias("f"))
    asked = wanted.join(owners, [*keys, "key"]).select(*keys, "key", F.col("f.pos").alias("pos"), F.col("f.code").alias("code"), "prop", "allowed", F.to_json(F.try_element_at(F.col("f.m"), F.col("prop"))).alias("now"))
    same = F.coalesce(F.array_join("allowed", "\n"), F.lit("\n"))  # equal where the allowed values are
    asked = asked.withColumn("same", same)
    need = asked.groupBy(*keys, "code", "prop", "same").agg(F.first("allowed").alias("allowed"))
    permitted = lambda v: _permitted(F.col("allowed"), v)
    offers = need.join(fields.select(*keys, "code", "pos", F.col("key").alias("from"), "m"), [*keys, "code"]).withColumn("v", F.try_element_at("m", F.col("prop")))
    offers = offers.where(F.col("v").isNotNull() & permitted(F.col("v")))
    # The first offer of each key, then the first two: one of them is not by the field that asks.
    offers = offers.groupBy(*keys, "code", "prop", "same", "from").agg(F.min("pos").alias("pos"), F.min_by(F.to_json("v"), "pos").alias("json"))
    offers = offers.groupBy(*keys, "code", "prop", "same").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "from", "json"))), 1, 2).alias("offers"))
    met = asked.join(offers, [*keys, "code", "prop", "same"], "left")
    sibling = F.get(F.filter("offers", lambda o: ~o["from"].eqNullSafe(F.col("key"))), F.lit(0))["json"]
    value = F.coalesce(sibling, _own_value(F.col("code"), F.col("prop"), F.col("allowed"), templates, defaults))
    found = met.withColumn("json", value).where((F.col("json") != "null") & ~F.col("json").eqNullSafe(F.col("now")))
    return found.groupBy(*keys, "pos", "prop").agg(F.min("json").alias("json"))


def mended(fields: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The fields with `values` (as `mends` returns them) set."""
    by_field = values.groupBy(*keys, "pos").agg(F.map_from_entries(F.collect_list(F.struct("prop", "json"))).alias("new"))
    kept = F.map_filter("m", lambda k, v: ~F.map_contains_key("new", k))
    m = F.when(F.col("new").isNull(), F.col("m")).otherwise(F.map_concat(kept, F.transform_values("new", lambda k, v: F.parse_json(v))))
    return fields.join(by_field, [*keys, "pos"], "left").withColumn("m", m).drop("new")


def _strange(v: Column, rules: dict, left: int, depth: int, path: Column) -> Column:
    """(depth, path, name) of the unknown names below a node that a reader gets to; null if there are more levels than `left`."""
    none = F.array().cast(_STRANGE)
    read = lambda c: c["name"].isNull() | c["name"].isin(list(rules["allowed_keys"])) | c["name"].rlike(PLACE)
    kids = F.coalesce(F.filter(_kids(v), read), F.array())
    if not left:
        return F.when(F.size(F.coalesce(_kids(v), F.array())) < 1, none)

    def below(c: Column, i: Column) -> Column:
        here = F.concat(path, F.array(F.coalesce(c["name"], F.concat(F.lit("["), i.cast("string"), F.lit("]")))))
        own = F.array(F.struct(F.lit(depth + 1).alias("depth"), here.alias("path"), c["name"].alias("name")))
        known = c["name"].isNull() | c["name"].isin(list(rules["known"]))
        return F.concat(F.when(known, none).otherwise(own), _strange(c["v"], rules, left - 1, depth + 1, here))

    return F.flatten(F.transform(kids, below))


def _values(wanted: Column, fields: Column, rules: dict) -> Column:
    """What `mends` says, within a row: (pos, prop, json), one for each property of a field."""
    named = F.reverse(F.transform(fields, lambda f: F.when(f["code"].isNotNull(), f["key"])))

    def one(w: Column, pos: Column) -> Column:
        owner = F.get(fields, pos)
        other = F.filter(fields, lambda f: (f["code"] == owner["code"]) & ~f["key"].eqNullSafe(w["key"]) & let(F.try_element_at(f["m"], w["prop"]), lambda v: v.isNotNull() & _permitted(w["allowed"], v)))
        sibling = F.to_json(F.try_element_at(F.get(other, F.lit(0))["m"], w["prop"]))
        json_ = F.coalesce(sibling, _own_value(owner["code"], w["prop"], w["allowed"], rules.get("templates"), rules.get("defaults")))
        now = F.to_json(F.try_element_at(owner["m"], w["prop"]))
        return F.struct(pos.alias("pos"), w["prop"].alias("prop"), F.nullif(json_, now).alias("json"))

    def found(last_first: Column) -> Column:
        spot = lambda w: (F.size(fields) - F.array_position(last_first, w["key"])).cast("int")
        asked = F.filter(wanted, lambda w: F.array_contains(last_first, w["key"]))
        made = F.filter(F.transform(asked, lambda w: let(spot(w), lambda pos: one(w, pos))), lambda x: x["json"] != "null")
        first = lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["pos"] != x["pos"]) | (F.get(s, j - 1)["prop"] != x["prop"]))
        return let(F.sort_array(made), first)

    return F.when(F.size(wanted) < 1, F.array().cast(_VALUES)).otherwise(let(named, found))


def _round(rules: dict, rounds: int) -> Callable[[Column, Column], Column]:
    """One round of a document that is still open (rounds is 0)."""

    def step(s: Column, turn: Column) -> Column:
        odd = F.array_min(s["strange"])["name"]
        said = lambda f: complaints(rules, lambda part: f[part])
        errors = F.when(odd.isNotNull(), F.array(F.concat(F.lit('Unrecognized field "'), odd, F.lit('"')))).otherwise(F.flatten(F.transform(s["fields"], said)))
        read = lambda e: F.struct(e.alias("errors"), F.flatten(F.transform(e, unknown_names)).alias("names"), F.flatten(F.transform(e, wanted_of)).alias("wanted"))
        with_values = lambda r: let(_values(r["wanted"], s["fields"], rules), lambda new: after(r, new))

        def after(r: Column, new: Column) -> Column:
            bare = (F.size(r["names"]) < 1) & (F.size(new) < 1)
            idle = bare & (F.size(r["wanted"]) < 1)
            ends = F.when(idle, turn).when(bare | (turn == rounds), F.lit(rounds)).otherwise(0)
            of = lambda i: F.map_from_entries(F.transform(F.filter(new, lambda x: x["pos"] == i), lambda x: F.struct(x["prop"], F.parse_json(x["json"]))))
            put = lambda f, n: F.map_concat(F.map_filter(f["m"], lambda k, v: ~F.map_contains_key(n, k)), n)
            mended_ = lambda f, i: F.when(F.exists(new, lambda x: x["pos"] == i), F.struct(f["key"].alias("key"), f["code"].alias("code"), let(of(i), lambda n: put(f, n)).alias("m"))).otherwise(f)
            fields = F.when(F.size(new) < 1, s["fields"]).otherwise(F.transform(s["fields"], mended_))
            gone = F.concat(s["gone"], r["names"])
            above = lambda x: F.array(F.lit(O.FIELDS), F.concat(F.lit("["), x["pos"].cast("string"), F.lit("]")), x["prop"])
            inner = F.flatten(F.transform(F.filter(new, lambda x: x["json"].rlike("^[{\\[]")), lambda x: _strange(F.parse_json(x["json"]), rules, ROW_LEVELS, 3, above(x))))
            left = F.filter(F.concat(s["strange"], inner), lambda x: ~F.arrays_overlap(x["path"], gone))
            # What is told can matter no more once a document has ended.
            strange = F.when(ends > 0, s["strange"]).otherwise(left)
            return F.struct(fields.alias("fields"), strange.alias("strange"), gone.alias("gone"), r["errors"].alias("errors"), ends.alias("rounds"), (s["set"] | (F.size(new) > 0)).alias("set"))

        return F.when(s["rounds"] > 0, s).otherwise(let(let(errors, read), with_values))

    return step


def _mended_in_row(doc: Column, rules: dict, rounds: int) -> Column:
    """The state of a document after its rounds; null if it is not for a row: too many fields or levels."""
    none, field = F.array(), lambda v: F.struct(F.try_variant_get(v, f"$.{O.KEY}", "string").alias("key"), F.try_variant_get(v, f"$.{O.TYPE}", "string").alias("code"), members(v).alias("m"))
    fields = F.coalesce(F.transform(elements(at(doc, O.FIELDS)), field), none.cast(f"array<{_FIELD}>"))
    zero = F.struct(fields.alias("fields"), _strange(doc, rules, ROW_LEVELS, 0, none.cast("array<string>")).alias("strange"), none.cast("array<string>").alias("gone"), none.cast("array<string>").alias("errors"), F.lit(0).alias("rounds"), F.lit(False).alias("set")).cast(_STATE)
    run = lambda z: F.when((F.size(z["fields"]) <= ROW_FIELDS) & z["strange"].isNotNull(), F.aggregate(F.array(*map(F.lit, range(1, rounds + 1))), z, _round(rules, rounds)))
    return let(let(zero, run), lambda s: F.when(s["strange"].isNotNull(), s))


def repaired(docs: DataFrame, doc: str, keys: list[str], rules: dict, base: str | None = None, rounds: int = O.REPAIR_ROUNDS) -> DataFrame:
    """J-25, J-26, J-27, (`keys`, doc, errors, new_errors, rounds): every document projected, validated and mended.

    doc, base: VARIANT columns; `keys` are unique. rules: `known` and `allowed_keys` (all that the rules ask for among both), and by
    type code the `types` with name, required properties and allowed values; `templates` and `defaults` by type code. A document
    is read through its allowed keys, and so are values that it is mended with. The first unknown key (of the highest, by path)
    is all that is told of it, and is stripped from what is read, then and later; else all missing and odd values are told, and
    mended in the document. A document ends when nothing is told that can be mended, or with the last round's messages. new_errors are those that the base, treated alike, does not have;
    a missing base has none. A missing document gives a missing one without errors; what is no object stays as it is."""
    state = docs.select(*keys, F.col(doc).alias("_doc"), (F.col(base) if base else F.lit(None).cast("variant")).alias("_base"))
    state = state.withColumn("_s", _mended_in_row(F.col("_doc"), rules, rounds)).withColumn("_b", F.when(F.col("_base").isNotNull(), _mended_in_row(F.col("_base"), rules, rounds)["errors"]))
    fits = F.col("_s").isNotNull() & (F.col("_base").isNull() | F.col("_b").isNotNull())
    s, rest = F.col("_s"), F.map_filter(members(F.col("_doc")), lambda k, v: k != O.FIELDS)
    each = F.transform(F.arrays_zip(s["fields"].alias("f"), elements(at(F.col("_doc"), O.FIELDS)).alias("v")), lambda x: F.when(x["f"]["m"].isNull(), x["v"]).otherwise(F.to_variant_object(x["f"]["m"])))
    put = F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(O.FIELDS), F.to_variant_object(each))))
    text = F.to_json(F.when(s["set"], put).otherwise(F.col("_doc")))
    fresh = F.filter(s["errors"], lambda e: ~F.coalesce(F.array_contains(F.col("_b"), e), F.lit(False)))
    only = lambda c, name, there: F.when(there, c).alias(name)
    # Each document goes through its row once; what does not fit is carried on as it is.
    done = stored(state.select(*keys, fits.alias("_fits"), only(text, "doc", fits), only(s["errors"], "errors", fits), only(fresh, "new_errors", fits), only(s["rounds"], "rounds", fits), only(F.col("_doc"), "_doc", ~fits), only(F.col("_base"), "_base", ~fits)))
    small = done.where("_fits").select(*keys, "doc", "errors", "new_errors", "rounds")
    large = done.where("not _fits")
    if large.isEmpty():
        return small
    return small.unionByName(_repaired_by_rounds(large.select(*keys, "_doc", "_base"), "_doc", keys, rules, "_base" if base else None, rounds))


def _repaired_by_rounds(docs: DataFrame, doc: str, keys: list[str], rules: dict, base: str | None, rounds: int) -> DataFrame:
    """The same for documents of any size, by joins."""
    side = [*keys, "_side"]
    whole = docs.select(*keys, F.lit(0).alias("_side"), F.col(doc).alias("_doc"))
    if base:
        whole = whole.unionByName(docs.where(F.col(base).isNotNull()).select(*keys, F.lit(1).alias("_side"), F.col(base).alias("_doc")))
    first = fields = stored(fields_of(whole, "_doc", side))

    def unknown(tree: DataFrame) -> DataFrame:
        read = projected(tree, list(rules["allowed_keys"]))
        return read.where(F.col("name").isNotNull() & ~F.col("name").isin(list(rules["known"]))).select(*side, "depth", "path", "name")

    strange = stored(unknown(nodes(whole, "_doc", side)))
    open_, gone, ended, done = whole.select(*side), None, [], []
    for turn in range(1, rounds + 1):
        odd = strange.groupBy(*side).agg(F.min(F.struct("depth", "path", "name"))["name"].alias("odd"))
        told = fields.withColumn("told", complaints(rules)).where("size(told) > 0").groupBy(*side)
        told = told.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "told"))), lambda x: x["told"])).alias("told"))
        judged = open_.join(odd, side, "left").join(told, side, "left")
        none = F.array().cast("array<string>")
        errors = F.when(F.col("odd").isNotNull(), F.array(F.concat(F.lit('Unrecognized field "'), "odd", F.lit('"')))).otherwise(F.coalesce("told", none))
        judged = judged.select(*side, errors.alias("errors"))
        judged = stored(judged.select(*side, "errors", F.flatten(F.transform("errors", unknown_names)).alias("names"), F.flatten(F.transform("errors", wanted_of)).alias("wanted")))
        busy = judged.where("size(names) > 0 or size(wanted) > 0")
        ended.append(judged.where("size(names) = 0 and size(wanted) = 0").select(*side, "errors", F.lit(turn).alias("rounds")))
        wanted = busy.select(*side, F.explode("wanted").alias("w")).select(*side, "w.*")
        new = stored(mends(wanted, fields, side, rules.get("templates"), rules.get("defaults")))
        done.append(new.withColumn("turn", F.lit(turn)))
        # What neither loses a key nor gets a value would be told the same until the last round.
        moved = new.select(*side).unionByName(busy.where("size(names) > 0").select(*side)).distinct()
        stays = busy if turn == rounds else busy.join(moved, side, "left_anti")
        ended.append(stays.select(*side, "errors", F.lit(rounds).alias("rounds")))
        if turn == rounds:
            break
        open_ = stored(moved)
        if open_.isEmpty():
            break
        told = busy.select(*side, F.explode("names").alias("name"))
        gone = stored(told if gone is None else gone.unionByName(told))
        # Values that came in may bring names of their own; what was stripped once is not read again.
        inner = nodes(new.where("json rlike '^[{\\\\[]'").select(*side, "pos", "prop", F.parse_json("json").alias("v")), "v", [*side, "pos", "prop"])
        above = F.array(F.lit(O.FIELDS), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")), F.col("prop"))
        brought = unknown(inner.withColumn("path", F.concat(above, "path")).withColumn("depth", F.col("depth") + 3))
        names = gone.groupBy(*side).agg(F.collect_set("name").alias("names"))
        left = strange.join(open_, side, "left_semi").unionByName(brought).join(names, side, "left")
        strange = stored(left.where(F.col("names").isNull() | ~F.arrays_overlap("path", "names")).drop("names"))
        fields = stored(mended(fields.join(open_, side, "left_semi"), new, side))
    closed = ended[0]
    for part in ended[1:]:
        closed = closed.unionByName(part)
    values = done[0]
    for part in done[1:]:
        values = values.unionByName(part)
    values = values.where("_side = 0").groupBy(*side, "pos", "prop").agg(F.max_by("json", "turn").alias("json"))
    changed = mended(first.join(values.select(*side).distinct(), side, "left_semi"), values, side)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.to_json("m"), F.to_json("v")).alias("json")))), lambda x: x["json"])
    changed = changed.groupBy(*side).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("list"))
    rest = F.map_filter(members(F.col("_doc")), lambda k, v: k != O.FIELDS)
    put = F.to_json(F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(O.FIELDS), F.parse_json("list")))))
    out = whole.where("_side = 0").join(changed, side, "left").join(closed, side, "left")
    out = out.select(*keys, F.when(F.col("list").isNull(), F.to_json("_doc")).otherwise(put).alias("doc"), "errors", "rounds")
    if not base:
        return out.select(*keys, "doc", "errors", F.col("errors").alias("new_errors"), "rounds")
    known = closed.where("_side = 1").select(*keys, F.col("errors").alias("_known"))
    fresh = F.filter("errors", lambda e: ~F.coalesce(F.array_contains("_known", e), F.lit(False)))
    return out.join(known, keys, "left").select(*keys, "doc", "errors", fresh.alias("new_errors"), "rounds")
