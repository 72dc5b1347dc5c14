"""Declarative schemas: events, metrics and spans of a service type, checked when they are built and turned into dimension tables.

A schema is applied when records are read. Nothing of it is stored with them, so names, levels, limits and texts can change
without rewriting data.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import SchemaError
from tidemark.functions.render import placeholders
from tidemark.model import ALARM, NORMAL, WARNING

SEVERITY = {"normal": NORMAL, "warn": WARNING, "alarm": ALARM}
INTEGRAL = ("i64", "u64", "bool")
VTYPES = ("f32", "f64", *INTEGRAL, "blob")


@dataclass(frozen=True)
class Range:
    """Inclusive bounds; None is open."""

    low: float | None = None
    high: float | None = None

    @classmethod
    def parse(cls, text: str) -> Range:
        """From ..=70, 0..=70 or 0.. ; an excluded upper bound (0..70) is refused, as it would be read as included."""
        m = re.fullmatch(r"\s*(-?[0-9.]*[0-9])?\s*\.\.(=?)\s*(-?[0-9.]*[0-9])?\s*", text)
        if not m or bool(m[2]) != bool(m[3]):
            raise SchemaError(f"range {text!r}: write low..=high, ..=high or low..")
        return cls(*(float(x) if x else None for x in (m[1], m[3])))

    @property
    def open(self) -> bool:
        return self.low is None and self.high is None

    def check(self, what: str) -> None:
        if any(x is not None and math.isnan(x) for x in (self.low, self.high)):
            raise SchemaError(f"{what}: a bound is NaN")
        if self.low is not None and self.high is not None and self.low > self.high:
            raise SchemaError(f"{what}: {self.low} is above {self.high}")


def check_nesting(warn: Range, alarm: Range, what: str) -> None:
    """What is normal or warned about must lie within the alarm bounds, on each side where both are set."""
    if warn.low is not None and alarm.low is not None and alarm.low > warn.low:
        raise SchemaError(f"{what}: the alarm range starts inside the warn range")
    if warn.high is not None and alarm.high is not None and alarm.high < warn.high:
        raise SchemaError(f"{what}: the alarm range ends inside the warn range")


@dataclass(frozen=True)
class Event:
    id: int
    name: str
    level: int
    store: str = "default"
    tags: tuple[str, ...] = ()
    templates: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)  # name -> Spark type


@dataclass(frozen=True)
class State:
    code: int
    name: str
    severity: str = "normal"


@dataclass(frozen=True)
class Metric:
    id: int
    name: str
    vtype: str = "f64"
    kind: str = "gauge"  # gauge, state or counter
    unit: str | None = None
    store: str = "default"
    tags: tuple[str, ...] = ()
    warn: Range = Range()
    alarm: Range = Range()
    states: tuple[State, ...] = ()

    def check(self) -> None:
        what = f"metric {self.name}"
        if self.vtype not in VTYPES:
            raise SchemaError(f"{what}: no value type {self.vtype}")
        if (self.kind == "state") != bool(self.states):
            raise SchemaError(f"{what}: states are for metrics of kind state, and these need them")
        if self.states:
            codes, names = [s.code for s in self.states], [s.name for s in self.states]
            if self.vtype not in INTEGRAL:
                raise SchemaError(f"{what}: states need an integral value type")
            if not (self.warn.open and self.alarm.open):
                raise SchemaError(f"{what}: thresholds and states exclude each other")
            if len({*codes}) < len(codes) or len({*names}) < len(names) or not all(names):
                raise SchemaError(f"{what}: state codes and names must be unique and not empty")
            if any(s.severity not in SEVERITY for s in self.states):
                raise SchemaError(f"{what}: severities are {', '.join(SEVERITY)}")
            if self.vtype == "bool" and max(codes) > 1 or min(codes) < 0:
                raise SchemaError(f"{what}: a state code is out of range")
        elif self.vtype == "blob" and not (self.warn.open and self.alarm.open):
            raise SchemaError(f"{what}: a blob has no thresholds")
        self.warn.check(what)
        self.alarm.check(what)
        check_nesting(self.warn, self.alarm, what)


@dataclass(frozen=True)
class Span:
    id: int
    name: str
    store: str = "default"


@dataclass(frozen=True)
class Migration:
    """A step from one version to the next: a function on the records of the events and metrics that it names (all if none)."""

    from_version: int
    step: Callable[[DataFrame], DataFrame]
    events: tuple[int, ...] = ()
    metrics: tuple[int, ...] = ()


@dataclass(frozen=True)
class Schema:
    name: str
    version: int = 1
    languages: tuple[str, ...] = ("en",)
    events: tuple[Event, ...] = ()
    metrics: tuple[Metric, ...] = ()
    spans: tuple[Span, ...] = ()
    migrations: tuple[Migration, ...] = ()

    def __post_init__(self) -> None:
        for part in ("events", "metrics", "spans"):
            object.__setattr__(self, part, tuple(sorted(getattr(self, part), key=lambda x: x.id)))
        self.validate()

    def validate(self) -> None:
        if not self.name:
            raise SchemaError("a schema needs a name")
        if self.version < 1:
            raise SchemaError(f"{self.name}: versions start at 1")
        if not self.languages or len({*self.languages}) < len(self.languages):
            raise SchemaError(f"{self.name}: languages must be given and unique")
        for part in ("events", "metrics", "spans"):
            twice = [k for k, n in Counter(x.id for x in getattr(self, part)).items() if n > 1]
            if twice:
                raise SchemaError(f"{self.name}: {part} have the id {twice[0]} twice")
        for e in self.events:
            if e.templates and {*e.templates} != {*self.languages}:
                raise SchemaError(f"{self.name}.{e.name}: a template is needed for each language")
            for t in e.templates.values():
                if unknown := [p for p in placeholders(t) if p not in e.fields]:
                    raise SchemaError(f"{self.name}.{e.name}: the template names {unknown[0]}, which is no field")
        for m in self.metrics:
            m.check()
        steps = [m.from_version for m in self.migrations]
        if len({*steps}) < len(steps) or sorted(steps) != list(range(self.version - len(steps), self.version)):
            raise SchemaError(f"{self.name}: migrations must lead step by step to version {self.version}")

    def stores(self) -> list[str]:
        """Storage classes that the schema uses, sorted."""
        return sorted({x.store for part in (self.events, self.metrics, self.spans) for x in part})

    def event(self, key: int | str) -> Event | None:
        return next((e for e in self.events if key in (e.id, e.name)), None)

    def metric(self, key: int | str) -> Metric | None:
        return next((m for m in self.metrics if key in (m.id, m.name)), None)

    def span(self, key: int | str) -> Span | None:
        return next((s for s in self.spans if key in (s.id, s.name)), None)

    def language(self, name: str) -> str:
        """The language itself, or the first one if it is not known."""
        return name if name in self.languages else self.languages[0]

    def migrate(self, entries: DataFrame, from_version: int) -> DataFrame:
        """entries written under from_version, taken through the steps to this version. Other records pass by."""
        for m in sorted(self.migrations, key=lambda m: m.from_version):
            if m.from_version < from_version:
                continue
            if not m.events and not m.metrics:
                entries = m.step(entries)
                continue
            touched = entries["event"].isin(*m.events) | entries["metric"].isin(*m.metrics)
            entries = m.step(entries.where(touched)).unionByName(entries.where(~touched | touched.isNull()))
        return entries


@dataclass(frozen=True)
class Dimensions:
    """What schemas declare, as tables of known size, so that Spark's size check picks the joins with them."""

    events: DataFrame
    metrics: DataFrame
    states: DataFrame
    spans: DataFrame
    versions: DataFrame


_STRING, _INT, _LONG, _DOUBLE = pa.string(), pa.int32(), pa.int64(), pa.float64()
_KEY = {"schema_name": _STRING}
_EVENTS = _KEY | {"event": _INT, "name": _STRING, "level": _INT, "store": _STRING, "tags": pa.list_(_STRING)}
_METRICS = _KEY | {"metric": _INT, "metric_name": _STRING, "declared_vtype": _STRING, "store": _STRING, "unit": _STRING, "tags": pa.list_(_STRING), "metric_kind": _STRING}
_METRICS |= {c: _DOUBLE for c in ("warn_min", "warn_max", "alarm_min", "alarm_max")}
_STATES = _KEY | {"metric": _INT, "state_code": _LONG, "state": _STRING, "state_severity": _INT}
_SPANS = _KEY | {"span_kind": _INT, "kind_name": _STRING, "store": _STRING}
_VERSIONS = _KEY | {"version": _INT}


def local_table(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """rows as a table that the driver holds: Spark knows its size, and no task makes it."""
    schema = pa.schema(list(columns.items()))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(columns), schema.types, strict=True)], schema=schema))


def dimensions(spark: SparkSession, schemas: list[Schema]) -> Dimensions:
    bounds = lambda m: (None if x is None else float(x) for x in (m.warn.low, m.warn.high, m.alarm.low, m.alarm.high))
    return Dimensions(
        local_table(spark, [(s.name, e.id, e.name, e.level, e.store, list(e.tags)) for s in schemas for e in s.events], _EVENTS),
        local_table(spark, [(s.name, m.id, m.name, m.vtype, m.store, m.unit, list(m.tags), m.kind, *bounds(m)) for s in schemas for m in s.metrics], _METRICS),
        local_table(spark, [(s.name, m.id, t.code, t.name, SEVERITY[t.severity]) for s in schemas for m in s.metrics for t in m.states], _STATES),
        local_table(spark, [(s.name, x.id, x.name, x.store) for s in schemas for x in s.spans], _SPANS),
        local_table(spark, [(s.name, s.version) for s in schemas], _VERSIONS),
    )
