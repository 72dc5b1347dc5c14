"""Message templates: placeholders are compiled once into parts, which become a Spark expression over typed fields.

Strings, integers and booleans stay built-in expressions. Floating-point values need shortest round-trip digits without an
exponent, and half-even rounding of the exact binary value, which Spark's formatters don't give; an Arrow function makes those.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PART = re.compile(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)(?::([^{}]*))?\}")


def parts(template: str) -> list[str | tuple[str, str]]:
    """Literal strings and (field, spec) pairs. Doubled braces are single ones; an unterminated brace is literal."""
    out: list[str | tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(template):
        out.append(template[at : m.start()])
        out.append(m[0][0] if m[0] in ("{{", "}}") else (m[1], m[2] or ""))
        at = m.end()
    return [x for x in [*out, template[at:]] if x]


def placeholders(template: str) -> list[str]:
    return [x[0] for x in parts(template) if isinstance(x, tuple)]


def _plain(x: float, kind: type) -> str:
    if np.isinf(x):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(kind(x), unique=True, trim="-")


@F.pandas_udf(StringType())
def _shortest_double(v: pd.Series) -> pd.Series:
    return pd.Series([None if np.isnan(x) else _plain(x, np.float64) for x in v], dtype=object)


@F.pandas_udf(StringType())
def _shortest_float(v: pd.Series) -> pd.Series:
    return pd.Series([None if np.isnan(x) else _plain(x, np.float32) for x in v], dtype=object)


def _fixed(digits: int):
    @F.pandas_udf(StringType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(x) else f"{x:.{digits}f}" if np.isfinite(x) else _plain(x, np.float64) for x in v], dtype=object)

    return run


def formatted(value: Column, kind: str, spec: str = "") -> Column:
    """value as text. spec: nothing, .N (digits) or [<>^]W (width), also both."""
    m = re.fullmatch(r"([<>^]?)([0-9]*)(?:\.([0-9]+))?", spec)
    if not m:
        raise ValueError(f"format {spec!r} is not known")
    align, width, digits = m[1], int(m[2] or 0), m[3]
    if kind in ("float", "double"):
        out = _fixed(int(digits))(value.cast("double")) if digits is not None else (_shortest_float if kind == "float" else _shortest_double)(value)
        out = F.when(F.isnan(value), "NaN").otherwise(out)  # in pandas null and NaN are one
    elif digits is not None:
        out = F.substring(value.cast("string"), 1, int(digits))
    else:
        out = value.cast("string")
    if width:
        right = align == ">" or not align and kind not in ("string", "boolean")
        pad = F.greatest(F.lit(width) - F.length(out), F.lit(0))
        before = pad if right else F.floor(pad / 2).cast("int") if align == "^" else F.lit(0)
        out = F.concat(F.repeat(F.lit(" "), before), out, F.repeat(F.lit(" "), pad - before))
    return out


def rendered(template: str, fields: dict[str, str], value: Column) -> Column:
    """The template filled from a struct of typed fields; null where a field is null."""
    return F.concat(F.lit(""), *(F.lit(x) if isinstance(x, str) else formatted(value[x[0]], fields[x[0]], x[1]) for x in parts(template)))


def as_json(value: Column, fields: dict[str, str]) -> Column:
    """The fields as JSON; numbers that JSON lacks (NaN and infinities) become null."""
    def member(name: str, kind: str) -> Column:
        x = value[name]
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x) if kind in ("float", "double") else x

    return F.to_json(F.struct(*(member(n, k).alias(n) for n, k in fields.items())), {"ignoreNullFields": "false"})
