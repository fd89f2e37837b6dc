"""A batch of ops on a form as a fold over typed columns: J-09 to J-16, D-06. No Python per row.

A form's fields are an array of structs: key, title, type and a map of all other values as text. Ops are an array of structs; the fold
carries the draft, the failures and what was touched from one op to the next, so an op sees the ones before. The texts of
failures are those of operators.open_documents, which does the same on documents of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import open_documents as O
from .variants import let

FIELD = "struct<key:string,title:string,type:int,values:map<string,string>>"
BUTTON = "struct<part:string,name:string,values:map<string,string>>"
OP = f"struct<op:string,key:string,title:string,patch:map<string,string>,field:{FIELD},after:string,before:string,anchor_title:string,name:string>"
_TEXTS = "array<string>"
_STATE = f"struct<fields:array<{FIELD}>,form:map<string,string>,buttons:array<{BUTTON}>,failures:{_TEXTS},touched:{_TEXTS},touched_form:{_TEXTS},notes:{_TEXTS},rewrite:boolean,n:int>"
#: Never taken from a model: key and title, which are columns of their own here, and the default value.
OWN_VALUES = tuple(k for k in O.OWN_KEYS if k not in (O.KEY, O.TITLE))


def _repr(text: Column) -> Column:
    return F.when(text.isNull(), "None").otherwise(F.concat(F.lit("'"), text, F.lit("'")))


def _say(form: str, *values: Column) -> Column:
    """A failure's text with its places filled in order."""
    parts = form.replace("{!r}", "{}").split("{}")
    return F.concat(*[x for k, p in enumerate(parts) for x in ([F.lit(p)] + ([values[k]] if k < len(values) else []))])


def _named(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def place(fields: Column, key: Column, title: Column) -> Column:
    """Where (from 1) the field with this key is, else the one with this title; the first of several, 0 for none."""
    at = lambda name, wanted: F.when(_named(wanted), F.coalesce(F.array_position(fields[name], wanted), F.lit(0))).otherwise(0)
    return let(at("key", key), lambda p: F.when(p > 0, p).otherwise(at("title", title))).cast("int")


def _merged(values: Column, patch: Column) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, v: ~F.map_contains_key(patch, k)), patch)


def _patched(field: Column, patch: Column) -> Column:
    """A field with a patch on it; names of its own columns set those."""
    own = lambda name, old: F.when(F.map_contains_key(patch, F.lit(name)), F.try_element_at(patch, F.lit(name))).otherwise(old)
    rest = F.map_filter(patch, lambda k, v: ~k.isin(O.KEY, O.TITLE, O.TYPE))
    return F.struct(own(O.KEY, field["key"]).alias("key"), own(O.TITLE, field["title"]).alias("title"), own(O.TYPE, field["type"].cast("string")).cast("int").alias("type"), _merged(field["values"], rest).alias("values"))


def _with(state: Column, **changed: Column) -> Column:
    names = [x.split(":")[0] for x in ("fields:", "form:", "buttons:", "failures:", "touched:", "touched_form:", "notes:", "rewrite:", "n:")]
    # Not cast: the types are those of the state, and a cast would write all fields and buttons anew with each op.
    return F.struct(*[changed.get(k, state[k]).alias(k) for k in names])


def _step(templates: Column):
    def step(s: Column, o: Column) -> Column:
        number = s["n"] + 1
        fails = lambda why, kind=None: _with(s, n=number, failures=F.array_append(s["failures"], F.concat(F.lit("#"), number.cast("string"), F.lit(f" {kind}: " if kind else " "), why)))
        done = lambda **c: _with(s, n=number, **c)
        fields = s["fields"]
        placed = lambda body: let(place(fields, o["key"], o["title"]), body)
        lost = _say(O.NO_FIELD, _repr(o["key"]), _repr(o["title"]))
        bare = F.coalesce(F.size(o["patch"]) < 1, F.lit(True))

        held = F.map_contains_key(o["patch"], F.lit(O.KEY)) & ~F.try_element_at(o["patch"], F.lit(O.KEY)).eqNullSafe(o["key"])
        patch = F.map_filter(o["patch"], lambda k, v: (k != O.KEY) | ~held)
        noted = F.when(held, F.array_append(s["notes"], _say(O.KEPT_KEY, _repr(o["key"])))).otherwise(s["notes"])
        updated = lambda at, patch: (lambda new: F.when(at == 0, fails(lost, "update_field")).when(bare, fails(F.lit(O.NO_PATCH), "update_field")).when(F.size(patch) == 0, done(notes=noted)).otherwise(done(notes=noted, fields=F.transform(fields, lambda f, i: F.when(i == at - 1, _patched(f, patch)).otherwise(f)), touched=F.array_append(s["touched"], F.coalesce(new["key"], F.lit(""))))))(_patched(F.get(fields, at - 1), patch))
        update = placed(lambda at: let(patch, lambda p: updated(at, p)))

        f = o["field"]
        model = F.get(F.filter(fields, lambda x: x["type"].eqNullSafe(f["type"])), F.lit(0))
        taken = F.map_filter(model["values"], lambda k, v: ~k.isin(*OWN_VALUES))
        base = F.when(model.isNotNull(), taken).otherwise(F.try_element_at(templates, f["type"]))
        none = F.create_map().cast("map<string,string>")
        fresh = F.struct(f["key"].alias("key"), f["title"].alias("title"), f["type"].alias("type"), _merged(base, F.coalesce(f["values"], none)).alias("values"))
        anchor = F.when(_named(o["after"]), o["after"]).otherwise(o["before"])
        kept = lambda beside: F.when(~_named(anchor), F.size(fields)).otherwise(beside - 1 + _named(o["after"]).cast("int"))  # noqa: E731  fields before the new one
        added = lambda n: F.concat(F.slice(fields, F.lit(1), n), F.array(fresh), F.slice(fields, n + 1, F.greatest(F.size(fields) - n, F.lit(0))))
        add = let(place(fields, anchor, o["anchor_title"]), lambda beside: F.when(~F.coalesce(_named(f["key"]), F.lit(False)), fails(F.lit(O.NO_KEY), "add_field")).when(place(fields, f["key"], F.lit(None).cast("string")) > 0, fails(_say(O.TAKEN, _repr(f["key"])), "add_field")).when(base.isNull() | (F.size(base) < 1) & model.isNull(), fails(_say(O.NO_MODEL, F.coalesce(f["type"].cast("string"), F.lit("None"))), "add_field")).when(_named(anchor) & (beside == 0), fails(_say(O.NO_ANCHOR, _repr(anchor)), "add_field")).otherwise(done(fields=let(kept(beside), added), touched=F.array_append(s["touched"], f["key"]))))

        remove = placed(lambda at: F.when(at == 0, fails(lost, "remove_field")).otherwise(done(fields=F.filter(fields, lambda x, i: i != at - 1), touched=F.array_append(s["touched"], F.coalesce(F.get(fields, at - 1)["key"], F.lit(""))))))

        barred = F.array_sort(F.array_except(F.map_keys(o["patch"]), F.array(*map(F.lit, O.FORM_KEYS))))
        listed = F.concat(F.lit("['"), F.array_join(barred, "', '"), F.lit("']"))
        form = F.when(bare, fails(F.lit(O.NO_PATCH), "update_form")).when(F.size(barred) > 0, fails(_say(O.BARRED, listed), "update_form")).otherwise(done(form=_merged(s["form"], o["patch"]), touched_form=F.concat(s["touched_form"], F.map_keys(o["patch"]))))

        wanted = F.coalesce(o["name"], F.lit(""))
        spot = F.coalesce(F.array_position(F.transform(s["buttons"]["name"], lambda b: F.coalesce(b, F.lit(""))), wanted), F.lit(0))
        pressed = F.transform(s["buttons"], lambda b, i: F.when(i == spot - 1, F.struct(b["part"].alias("part"), F.coalesce(F.try_element_at(o["patch"], F.lit("buttonName")), b["name"]).alias("name"), _merged(b["values"], F.map_filter(o["patch"], lambda k, v: k != "buttonName")).alias("values"))).otherwise(b))
        button = F.when(spot == 0, fails(_say(O.NO_BUTTON, _repr(wanted)), "update_button")).when(bare, fails(F.lit(O.NO_PATCH), "update_button")).otherwise(done(buttons=pressed, touched_form=F.array_append(s["touched_form"], F.get(s["buttons"], (spot - 1).cast("int"))["part"])))

        kind = o["op"]
        chosen = F.when(kind == "update_field", update).when(kind == "add_field", add).when(kind == "remove_field", remove).when(kind == "update_form", form).when(kind == "update_button", button)
        return F.when(s["rewrite"], s).when(kind == "full_rewrite", done(rewrite=F.lit(True))).otherwise(chosen.otherwise(fails(_say(O.UNKNOWN_OP, _repr(kind)))))

    return step


def apply_ops(forms: DataFrame, templates: dict[int, dict[str, str]] | None = None) -> DataFrame:
    """`forms` (columns fields, form, buttons, ops and any others) after their batches: fields, form and buttons are the new ones if the
    batch went through (ok), else as they were; failures, touched, touched_form, notes, full_rewrite say what happened.

    All or nothing: every failure is told, and with any nothing changes. full_rewrite ends its batch; failures before it are told.
    Buttons stand in the order in which they are looked through. templates: values of a new field by type, where no field has it.
    An empty or missing batch is a failure."""
    known = F.create_map(*[x for k, v in (templates or {}).items() for x in (F.lit(k), F.create_map(*[F.lit(y) for kv in v.items() for y in kv]).cast("map<string,string>"))]) if templates else F.create_map().cast("map<int,map<string,string>>")
    none = F.array().cast(_TEXTS)
    zero = F.struct(F.col("fields"), F.col("form"), F.col("buttons"), none.alias("failures"), none.alias("touched"), none.alias("touched_form"), none.alias("notes"), F.lit(False).alias("rewrite"), F.lit(0).alias("n")).cast(_STATE)
    empty = F.coalesce(F.size("ops") < 1, F.lit(True))
    folded = forms.withColumn("_s", F.aggregate(F.coalesce(F.col("ops"), F.array().cast(f"array<{OP}>")), zero, _step(known)))
    s = F.col("_s")
    failures = F.when(empty, F.array(F.lit(O.NO_OPS))).otherwise(s["failures"])
    ok = (F.size(failures) == 0) & ~s["rewrite"]
    if_ok = lambda new, old: F.when(ok, new).otherwise(old)
    others = [c for c in forms.columns if c not in ("fields", "form", "buttons", "ops")]
    return folded.select(*others, ok.alias("ok"), s["rewrite"].alias("full_rewrite"), failures.alias("failures"), *[if_ok(s[c], F.col(c)).alias(c) for c in ("fields", "form", "buttons")], *[if_ok(s[c], none).alias(c) for c in ("touched", "touched_form", "notes")])
