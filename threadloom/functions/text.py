"""Text functions as column expressions; one Arrow function where Spark has no built-in (NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

RESERVE, TRIGGER = 20_000, 0.70
# Redaction rules in order (pattern, what stays of it), ranges of characters that are dropped.
SECRET_RULES = [
    (r"(?i)(Bearer\s+)[A-Za-z0-9\-._~+/]+=?", "$1***REDACTED***"),
    (r"(sk-)[a-zA-Z0-9]{8,}", "$1***REDACTED***"),
    (r"""(?i)((?:authorization|auth)["']?\s*[:=]\s*["']?)[^"',\s]+""", "$1***REDACTED***"),
    (r"""(?i)((?:cookie|set-cookie)["']?\s*[:=]\s*["']?)[^"',\s]+""", "$1***REDACTED***"),
    (r"""(?i)((?:x-api-key|x-token|x-auth-token|x-secret)["']?\s*[:=]\s*["']?)[^"',\s]+""", "$1***REDACTED***"),
    (r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "***REDACTED_JWT***"),
]
DROPPED = r"[\x{FEFF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{E000}-\x{F8FF}]"
# The three formats of a validator's messages that name what can be mended.
UNKNOWN_FIELD = r'Unrecognized field "(\w+)"'
MISSING_VALUE = r"([A-Za-z0-9_]+)\.([A-Za-z0-9_]+) 为必填项\(字段类型=([A-Z_]+)\)"
INVALID_VALUE = r"([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)=[^,，]+[,，]类型([A-Z_]+) 允许值=\[([^\]]*)\]"
CJK_COMPLEMENT = r"[^\x{4e00}-\x{9fff}]"
FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"


def estimate_tokens(text: Column) -> Column:
    """1.5 a CJK character, a quarter for any other, rounded down; null or empty: 0."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.length(F.regexp_replace(t, CJK_COMPLEMENT, ""))
    return F.floor(cjk * 1.5 + (F.length(t) - cjk) / 4.0).cast("long")


def compress_trigger(limit: int) -> int:
    """A history of more tokens than this is compressed; the double product is truncated toward zero, so it may be negative."""
    return int((limit - RESERVE) * TRIGGER)


def redact(text: Column) -> Column:
    """Apply the secret rules in order, each to what the one before left."""
    for pattern, keep in SECRET_RULES:
        text = F.regexp_replace(text, pattern, keep)
    return text


def drop_invisible(text: Column) -> Column:
    """Without byte-order marks, zero-width and direction characters and private-use code points."""
    return F.regexp_replace(text, DROPPED, "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; null stays null."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def sanitize(text: Column) -> Column:
    return drop_invisible(nfkc(text))


def json_from_text(text: Column) -> Column:
    """JSON text found in model output: the whole, else a fenced block, else from the first brace to the last; else null."""
    whole = F.trim(text)
    fenced = F.regexp_extract(text, FENCE, 1)
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.substring(text, first, last - first + 1)
    ok = lambda c: F.when(F.expr("true") & F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*[\{\[]"), c)
    return F.coalesce(ok(whole), ok(fenced), F.when(first > 0, ok(inner)))


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


_SPACE = " \t\r\n\x0b\x0c"


def _field_lines(frame: Column, name: str) -> Column:
    """What the lines `name:` of a frame say, trimmed, in order."""
    own = F.filter(F.split(frame, "\n"), lambda x: x.startswith(f"{name}:"))
    return F.transform(own, lambda x: F.btrim(F.substr(x, F.lit(len(name) + 2)), F.lit(_SPACE)))


def sse_event(frame: Column) -> Column:
    """The event of a frame: what its last `event:` line says, null if that is nothing or there is none."""
    return F.nullif(F.try_element_at(_field_lines(frame, "event"), F.lit(-1)), F.lit(""))


def sse_data(frame: Column) -> Column:
    """The data of a frame: its `data:` lines, one after the other with nothing between."""
    return F.array_join(_field_lines(frame, "data"), "")


def csv_list(text: Column) -> Column:
    """Items of a comma-separated list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def with_suffix(name: Column, suffix: str = ".json") -> Column:
    return F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))
