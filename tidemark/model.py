"""Codes and column layouts of the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels, severities, anchor sources and record kinds, by code.
LEVELS = ("DevTrace", "Trace", "Debug", "Info", "Warn", "Error")
SEVERITIES = ("normal", "warn", "alarm")
SOURCES = ("None", "User", "Ntp", "Gps")
KINDS = ("message", "span_start", "span_end", "sample", "text", "ext")
DEV_TRACE, TRACE, DEBUG, INFO, WARN, ERROR = range(6)
NORMAL, WARNING, ALARM = range(3)

LOGS = ("message", "text")
TELEMETRY = ("sample",)
SPANS = ("span_start", "span_end")

#: Record columns; a record fills those of its kind.
ENTRIES = {
    "namespace": "string", "channel": "string", "boot": "bigint", "at_us": "bigint", "seq": "bigint", "kind": "string",
    "event": "int", "payload": "binary", "span": "bigint", "span_kind": "int", "parent": "bigint",
    "metric": "int", "vtype": "string", "v_f32": "float", "v_f64": "double", "v_i64": "bigint", "v_u64": "decimal(20,0)", "v_bool": "boolean", "v_blob": "binary",
    "text_level": "tinyint", "target": "string", "text": "string", "ext": "binary", "store_id": "decimal(20,0)", "protocol_version": "int",
}


def as_entries(df):
    """df with the columns of ENTRIES, in order and type; those it lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in ENTRIES.items()))


def label(code: Column, names: tuple[str, ...]) -> Column:
    """Name of a code; null for null and for codes out of range."""
    out = F.lit(None).cast("string")
    for i, name in enumerate(names):
        out = F.when(code == i, name).otherwise(out)
    return out


def code(name: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for i, x in enumerate(names):
        out = F.when(name == x, i).otherwise(out)
    return out
