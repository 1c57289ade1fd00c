"""The query language's functions as Column builders, and the registry that queries look them up in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions import temporal

#: What trim() strips.
BLANKS = " \t\n\r"


def divide(a: Column, b: Column, integral: bool) -> Column:
    """Truncating for integers; null on a zero divisor instead of an error."""
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0)))) if integral else F.try_divide(a, b)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Zero-based; a negative start counts as 0, past the end gives ''."""
    begin = F.greatest(start, F.lit(0)).cast("int")
    size = F.length(s) if length is None else F.greatest(length, F.lit(0)).cast("int")
    return F.substr(s, begin + 1, size)


def to_string(x: Column) -> Column:
    return x.cast("string")


def _pad(side: str) -> Callable[[Column], Column]:
    pattern = {"both": f"^[{BLANKS}]+|[{BLANKS}]+$", "left": f"^[{BLANKS}]+", "right": f"[{BLANKS}]+$"}[side]
    return lambda s: F.regexp_replace(s, pattern, "")


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x).cast("bigint")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _size(x: Column) -> Column:
    """Length of a string or of a list; the analyser knows which, so both are built lazily by the compiler."""
    return F.length(x)


SCALARS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "ceil": _whole(F.ceil),
    "coalesce": F.coalesce,
    "contains": lambda s, t: _flag(F.contains(s, t)),
    "current_timestamp": lambda: F.current_timestamp().cast("timestamp_ntz"),
    "date": lambda s: F.to_date(s),
    "datetime": lambda s: F.to_timestamp_ntz(s),
    "element_at": lambda a, i: F.get(a, i.cast("int")),
    "ends_with": lambda s, t: _flag(F.endswith(s, t)),
    "exp": F.exp,
    "floor": _whole(F.floor),
    "format_iso8601": temporal.format_iso8601,
    "head": lambda a: F.get(a, F.lit(0)),
    "json": lambda s, path: F.call_function("get_json_object", s, path),
    "keys": F.map_keys,
    "last": lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)),
    "left": lambda s, n: substring(s, F.lit(0), n),
    "length": _size,
    "ln": F.ln,
    "log10": F.log10,
    "ltrim": _pad("left"),
    "micros": temporal.micros,
    "now": lambda: F.current_timestamp().cast("timestamp_ntz"),
    "pow": F.pow,
    "range": lambda a, b, step=None: F.sequence(a, b) if step is None else F.sequence(a, b, step),
    "replace": lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)),
    "reverse": F.reverse,
    "right": lambda s, n: F.right(s, n),
    "round": _whole(F.round),
    "rtrim": _pad("right"),
    "sign": F.signum,
    "size": _size,
    "split": lambda s, d: F.split(s, d),
    "sqrt": F.sqrt,
    "starts_with": lambda s, t: _flag(F.startswith(s, t)),
    "string": to_string,
    "substr": substring,
    "substring": substring,
    "tail": lambda a: F.slice(a, 2, F.greatest(F.size(a), F.lit(1))),
    "timestamp": lambda x: temporal.from_micros(x),
    "toboolean": lambda x: x.try_cast("boolean"),
    "tofloat": lambda x: x.try_cast("double"),
    "tointeger": lambda x: x.try_cast("double").try_cast("bigint"),
    "tolower": F.lower,
    "tostring": to_string,
    "toupper": F.upper,
    "trim": _pad("both"),
}
SCALARS["lower"], SCALARS["upper"] = F.lower, F.upper
