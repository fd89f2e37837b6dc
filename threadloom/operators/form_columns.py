"""Rules on one open form document as column expressions over a VARIANT: no exchange, no Python worker.

Objects come with their keys by name, as VARIANT keeps them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import open_documents as O
from .variants import let, members, quoted


def at(v: Column, name: str) -> Column:
    """A member of an object; null where there is none, or where the member is null."""
    found = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(found), found)


def told(v: Column, name: str, missing: str = "") -> Column:
    """A member as text."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(missing))


def holds(v: Column) -> Column:
    """Whether a value says yes: not missing, null, false, 0, or empty."""
    return F.coalesce(~F.to_json(v).isin("null", "false", "0", '""', "[]", "{}"), F.lit(False))


def catalog(doc: Column, type_names: dict[str, str] | None = None) -> Column:
    """J-01, (text, keys): a line per field with what a patch needs to know, the form's own values, its buttons; null for what is
    no object.

    Elements of the field array that are no objects are read as fields without a key, a title or a type."""
    names = F.create_map(*[F.lit(x) for kv in (type_names or {"": ""}).items() for x in kv])
    # Everything is read in one pass over the document; a member of another shape than said is null.
    field = f"struct<`{O.KEY}`:string,`{O.TITLE}`:string,`{O.TYPE}`:string,`{O.REQUIRED}`:variant,`{O.OPTIONS}`:variant,options:array<variant>>"
    button = "array<struct<buttonName:string>>"
    shape = f"struct<`{O.FIELDS}`:array<{field}>,{','.join(f'`{k}`:variant' for k in O.CATALOG_KEYS)},{','.join(f'`{p}`:{button}' for p in O.BUTTON_PARTS)}>"
    none, there = F.array().cast("array<string>"), lambda v: F.when(~F.is_variant_null(v), v)

    def line(f: Column, n: Column) -> Column:
        code, settings = F.coalesce(f[O.TYPE], F.lit("?")), f[O.OPTIONS]
        listed = F.coalesce(F.try_variant_get(settings, "$.optionFields", "array<variant>"), f["options"])
        shown = F.when(F.size(listed) > 0, F.concat(F.lit(" | 选项:"), F.substring(F.coalesce(F.to_json(there(settings)), F.lit("null")), 1, O.OPTION_CHARS))).otherwise("")
        needed = F.when(holds(f[O.REQUIRED]), "必填").otherwise("可选")
        numbered = F.array_join(F.array(F.lit("#"), (n + 1).cast("string"), F.lit(" "), F.coalesce(f[O.KEY], F.lit(""))), "")
        return F.array_join(F.array(numbered, F.coalesce(f[O.TITLE], F.lit("")), let(code, lambda c: F.coalesce(F.try_element_at(names, c), c)), F.array_join(F.array(needed, shown), "")), " | ")

    def told_of(d: Column) -> Column:
        fields = F.coalesce(d[O.FIELDS], F.array())
        own = F.array_compact(F.array(*[F.concat(F.lit(f'"{k}": '), F.to_json(there(d[k]))) for k in O.CATALOG_KEYS]))
        form = let(own, lambda o: F.when(F.size(o) > 0, F.concat(F.lit("表单属性: {"), F.array_join(o, ", "), F.lit("}"))))
        part = {p: F.coalesce(F.transform(d[p], lambda b: F.coalesce(b["buttonName"], F.lit(""))), none) for p in O.BUTTON_PARTS}
        shown = [F.concat(F.lit(f"{p.removesuffix('Buttons')}=["), F.array_join(F.transform(names_, quoted), ", "), F.lit("]")) for p, names_ in part.items()]
        buttons = F.when(F.size(F.concat(*part.values())) > 0, F.concat(F.lit("按钮: "), F.concat_ws(" ", *shown)))
        head = F.lit("## 字段目录（key 是唯一定位锚点，指令里必须原样抄写）")
        text = F.array_join(F.concat(F.array(head), F.transform(fields, line), F.array_compact(F.array(form, buttons))), "\n")
        keys = F.filter(F.transform(fields, lambda f: f[O.KEY]), lambda k: k != "")
        return F.struct(text.alias("text"), keys.alias("keys"))

    return let(F.try_variant_get(doc, "$", shape), lambda d: F.when(d.isNotNull(), told_of(d)))


def cloned(doc: Column, name: Column, code: Column) -> Column:
    """I-17, J-23: a copy as JSON text, under its own code and name (where these are null or empty, the source's with a mark), without
    the keys that only the source's record has; null for what is no object."""
    mine = lambda given, key, mark: F.coalesce(F.nullif(given, F.lit("")), F.concat(told(doc, key), F.lit(mark)))
    own = {"formCode": mine(code, "formCode", "_copy"), "formName": mine(name, "formName", "(副本)")}
    rest = F.map_filter(members(doc), lambda k, v: ~k.isin(*O.AUDIT_KEYS, *own))
    return F.to_json(F.to_variant_object(F.map_concat(rest, F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.parse_json(quoted(v)))]))))
