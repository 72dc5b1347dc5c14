"""Runtime limits: a per-namespace overlay on declared thresholds and state severities. Never stored with records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import SchemaError
from tidemark.model import SEVERITIES, label
from tidemark.operators.enrich import severity
from tidemark.schema import SEVERITY, Range, Schema, check_nesting

BOUNDS = ("warn_min", "warn_max", "alarm_min", "alarm_max")


@dataclass
class Limits:
    """Overrides by (namespace, metric id); setting one replaces the whole of what was set before."""

    schemas: dict[str, Schema]  # by namespace
    ranges: dict[tuple[str, int], tuple[Range, Range]] = field(default_factory=dict)
    states: dict[tuple[str, int], dict[int, str]] = field(default_factory=dict)

    def _metric(self, namespace: str, metric: int):
        found = self.schemas[namespace].metric(metric) if namespace in self.schemas else None
        if found is None:
            raise SchemaError(f"{namespace} has no metric {metric}")
        return found

    def set_ranges(self, namespace: str, metric: int, warn: Range = Range(), alarm: Range = Range()) -> None:
        m = self._metric(namespace, metric)
        if m.states:
            raise SchemaError(f"metric {m.name}: thresholds are for metrics without states")
        for r in (warn, alarm):
            r.check(f"metric {m.name}")
        check_nesting(warn, alarm, f"metric {m.name}")
        self.ranges[namespace, metric] = (warn, alarm)

    def set_states(self, namespace: str, metric: int, severities: dict[int, str]) -> None:
        m = self._metric(namespace, metric)
        if not m.states:
            raise SchemaError(f"metric {m.name} has no states")
        for code, name in severities.items():
            if code not in {s.code for s in m.states} or name not in SEVERITY:
                raise SchemaError(f"metric {m.name}: state {code} or severity {name} is not declared")
        self.states[namespace, metric] = dict(severities)

    def clear(self, namespace: str, metric: int) -> None:
        self.ranges.pop((namespace, metric), None)
        self.states.pop((namespace, metric), None)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        bounds = [(*k, *(None if x is None else float(x) for x in (w.low, w.high, a.low, a.high))) for k, (w, a) in self.ranges.items()]
        states = [(*k, code, SEVERITY[s]) for k, v in self.states.items() for code, s in v.items()]
        return (
            spark.createDataFrame(bounds, "namespace string, metric int, o_warn_min double, o_warn_max double, o_alarm_min double, o_alarm_max double"),
            spark.createDataFrame(states, "namespace string, metric int, state_code bigint, o_state int"),
        )


def effective(namespaces: DataFrame, metrics: DataFrame, overrides: DataFrame) -> DataFrame:
    """(namespace, metric, bounds, overridden): what holds for each numeric metric of each namespace. An override replaces all four bounds."""
    out = namespaces.select("namespace", "schema_name").join(metrics.where("metric_kind <> 'state'"), "schema_name")
    out = out.join(overrides.withColumn("overridden", F.lit(True)), ["namespace", "metric"], "left").withColumn("overridden", F.coalesce("overridden", F.lit(False)))
    return out.select("namespace", "metric", *(F.when(F.col("overridden"), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in BOUNDS), "overridden")


def with_limits(samples: DataFrame, metrics: DataFrame, states: DataFrame, overrides: tuple[DataFrame, DataFrame]) -> DataFrame:
    """samples (namespace, schema_name, metric, number, state_code) with severity under the overlay."""
    ranges, by_state = overrides
    out = samples.join(metrics.select("schema_name", "metric", "metric_kind", *BOUNDS), ["schema_name", "metric"], "left")
    out = out.join(states.select("schema_name", "metric", "state_code", "state_severity"), ["schema_name", "metric", "state_code"], "left")
    out = out.join(ranges.withColumn("__o", F.lit(True)), ["namespace", "metric"], "left").join(by_state, ["namespace", "metric", "state_code"], "left")
    bounds = {c: F.when(F.col("__o"), F.col(f"o_{c}")).otherwise(F.col(c)) for c in BOUNDS}
    out = out.withColumn("state_severity", F.coalesce("o_state", "state_severity"))
    out = out.withColumn("severity_code", severity(bounds)).withColumn("severity", label(F.col("severity_code"), SEVERITIES))
    return out.drop("__o", "o_state", "state_severity", *BOUNDS, *(f"o_{c}" for c in BOUNDS))
