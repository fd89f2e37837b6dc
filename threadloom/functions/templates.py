"""Prompt templates compiled into column expressions: L-10, L-11.

The part of the template language that prompts use: `{{ name }}`, `{{ a.b }}`, `{{ x | tojson }}`, `{% if [not] x %}`, `{% else %}`,
`{% endif %}`, `{% for x in xs %}` with `loop.index`, `{% endfor %}`, comments, and `-` that eats white space. A template is read once,
on the driver; what comes out is one expression that Catalyst sees through, so only the columns that it names are read. Names
that no column has are an error when it is compiled. A template without names is folded into a literal, once; a head between two
lines of `---` with `cacheable: false` keeps it from the store of such literals. The head stays part of the text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

_TOKEN = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_NAME = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*"

#: A value in a template: an expression and its type.
Value = tuple[Column, T.DataType]


def head(template: str) -> dict[str, object]:
    """What stands between two lines of --- at the top: flat names with texts, numbers, true or false."""
    found = re.match(r"---\n(.*?)---\n", template, re.S)
    plain = {"true": True, "false": False}
    pairs = [line.split(":", 1) for line in (found.group(1).splitlines() if found else []) if ":" in line]
    return {k.strip(): plain.get(v.strip(), int(v) if v.strip().isdigit() else v.strip()) for k, v in pairs}


@dataclass
class _Block:
    """Parts in order: texts, ("value", name, filter), or an inner block under ("if", name, negated) / ("for", variable, name)."""

    opened: tuple | None = None
    parts: list = field(default_factory=list)
    other: list | None = None

    def add(self, part: object) -> None:
        (self.parts if self.other is None else self.other).append(part)


def parsed(template: str) -> list:
    """The parts of a template. Tags that are not known, not closed or not opened are errors."""
    text = template[:-1] if template.endswith("\n") else template
    stack, pieces = [_Block()], _TOKEN.split(text)
    for k, piece in enumerate(pieces):
        if not k % 2:
            if k and pieces[k - 1].endswith(("-}}", "-%}")):
                piece = piece.lstrip()
            if k + 1 < len(pieces) and pieces[k + 1].startswith(("{{-", "{%-")):
                piece = piece.rstrip()
            if piece:
                stack[-1].add(piece)
            continue
        inner = piece[2:-2].strip("-").strip()
        if piece.startswith("{#"):
            continue
        if piece.startswith("{{"):
            m = re.fullmatch(rf"({_NAME})(?:\s*\|\s*(tojson))?", inner)
            if not m:
                raise ValueError(f"not understood: {piece}")
            stack[-1].add(("value", m[1], m[2]))
        elif m := re.fullmatch(rf"if\s+(not\s+)?({_NAME})", inner):
            stack.append(_Block(("if", m[2], bool(m[1]))))
        elif m := re.fullmatch(rf"for\s+([A-Za-z_]\w*)\s+in\s+({_NAME})", inner):
            stack.append(_Block(("for", m[1], m[2])))
        elif inner == "else" and stack[-1].opened and stack[-1].opened[0] == "if" and stack[-1].other is None:
            stack[-1].other = []
        elif inner in ("endif", "endfor") and stack[-1].opened and inner == f"end{stack[-1].opened[0]}":
            done = stack.pop()
            stack[-1].add(done)
        else:
            raise ValueError(f"not understood: {piece}")
    if len(stack) > 1:
        raise ValueError(f"not closed: {stack[-1].opened}")
    return stack[0].parts


def _found(name: str, known: dict[str, Value]) -> Value:
    if name in known:
        return known[name]
    first, *path = name.split(".")
    if first not in known:
        raise KeyError(f"{first} is undefined")
    value, kind = known[first]
    for step in path:
        if not isinstance(kind, T.StructType) or step not in kind.names:
            raise KeyError(f"{name} is undefined")
        value, kind = value[step], kind[step].dataType
    return value, kind


def _text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        shown = F.when(value, "True").otherwise("False")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        raise TypeError("an object or a list needs | tojson")
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), "None").otherwise(shown)


def _json(value: Column) -> Column:
    """JSON with a blank after every comma and colon that is not in a text; nulls are told."""
    bare = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    inner = F.substr(bare, F.lit(2), F.length(bare) - 2)
    return F.regexp_replace(inner, r'\G((?:[^",:]|"(?:[^"\\]|\\.)*+")*+[,:])', r"$1 ")


def _true(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        held = value
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        held = F.size(value) > 0
    elif isinstance(kind, T.StringType):
        held = value != ""
    elif isinstance(kind, T.NumericType):
        held = value != 0
    else:
        held = value.isNotNull()
    return F.coalesce(held, F.lit(False))


def _joined(parts: list, known: dict[str, Value]) -> Column:
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(F.lit(part))
        elif isinstance(part, tuple):
            value, kind = _found(part[1], known)
            out.append(_json(value) if part[2] else _text(value, kind))
        elif part.opened[0] == "if":
            holds = _true(*_found(part.opened[1], known))
            out.append(F.when(~holds if part.opened[2] else holds, _joined(part.parts, known)).otherwise(_joined(part.other or [], known)))
        else:
            listed, kind = _found(part.opened[2], known)
            if not isinstance(kind, T.ArrayType):
                raise TypeError(f"{part.opened[2]} is no list")
            out.append(F.coalesce(F.array_join(_each(part, listed, kind.elementType, known), ""), F.lit("")))
    return F.concat(*out) if out else F.lit("")


def _each(part: _Block, listed: Column, kind: T.DataType, known: dict[str, Value]) -> Column:
    return F.transform(listed, lambda x, i: _joined(part.parts, known | {part.opened[1]: (x, kind), "loop.index": (i + 1, T.IntegerType())}))


_STATIC: dict[str, str] = {}


def static(template: str) -> str | None:
    """The text of a template that names nothing, kept unless its head says cacheable: false; None if it names something."""
    if template in _STATIC:
        return _STATIC[template]
    parts = parsed(template)
    if not all(isinstance(p, str) for p in parts):
        return None
    text = "".join(parts)
    if head(template).get("cacheable", True):
        _STATIC[template] = text
    return text


def rendered(df: DataFrame, template: str) -> Column:
    """A template filled from the columns of `df`."""
    fixed = static(template)
    return F.lit(fixed) if fixed is not None else _joined(parsed(template), {f.name: (df[f.name], f.dataType) for f in df.schema.fields})


def assembled(df: DataFrame, sections: list[str], template: str, override: Column | None = None, append: Column | None = None) -> Column:
    """A whole prompt: an override that says something stands alone; else the sections, the filled template and what is appended,
    with an empty line between, without blank ones. Sections name nothing."""
    fixed = [static(s) for s in sections]
    if None in fixed:
        raise KeyError("a section names a variable")
    parts = [*map(F.lit, fixed), rendered(df, template), *([append] if append is not None else [])]
    shown = F.filter(F.array(*parts), lambda p: p.rlike(r"\S"))
    whole = F.array_join(shown, "\n\n")
    return F.when(F.coalesce(override, F.lit("")) != "", override).otherwise(whole) if override is not None else whole
