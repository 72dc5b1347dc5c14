"""Schema-on-read: names, levels, tags, units, state labels and severities joined to records from dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.render import as_json, rendered
from tidemark.functions.scalars import as_double, outside, state_code
from tidemark.model import ALARM, NORMAL, SEVERITIES, WARNING, label
from tidemark.schema import Dimensions, Schema


def severity(bounds: dict[str, Column] | None = None) -> Column:
    """Severity code of a sample; null if the metric is unknown. Undeclared states and blobs are normal."""
    b = bounds or {c: F.col(c) for c in ("warn_min", "warn_max", "alarm_min", "alarm_max")}
    v = F.col("number")
    measured = F.when(outside(v, b["alarm_min"], b["alarm_max"]), ALARM).when(outside(v, b["warn_min"], b["warn_max"]), WARNING).otherwise(NORMAL)
    by_state = F.coalesce(F.col("state_severity"), F.lit(NORMAL))
    return F.when(F.col("metric_kind").isNull(), None).when(F.col("metric_kind") == "state", by_state).when(v.isNull(), NORMAL).otherwise(measured)


def messages(entries: DataFrame, dims: Dimensions) -> DataFrame:
    """entries (with schema_name) with name, level and tags of their events. Unknown events have no name and no level, and no tags."""
    d = dims.events.select("schema_name", "event", "name", "level", F.col("tags").alias("event_tags"))
    return entries.join(d, ["schema_name", "event"], "left")


def samples(entries: DataFrame, dims: Dimensions) -> DataFrame:
    """entries with metric_name, unit, metric_kind, state, number and severity."""
    d = dims.metrics.drop("store", "declared_vtype").withColumnRenamed("tags", "metric_tags")
    out = entries.withColumn("number", as_double()).withColumn("state_code", F.when(F.col("kind") == "sample", state_code()))
    out = out.join(d, ["schema_name", "metric"], "left").join(dims.states, ["schema_name", "metric", "state_code"], "left")
    sample = F.col("kind") == "sample"
    out = out.withColumn("severity_code", F.when(sample, severity())).withColumn("severity", label(F.col("severity_code"), SEVERITIES))
    return out.drop("warn_min", "warn_max", "alarm_min", "alarm_max", "state_severity")


def spans(entries: DataFrame, dims: Dimensions) -> DataFrame:
    return entries.join(dims.spans.drop("store"), ["schema_name", "span_kind"], "left")


def effective_level() -> Column:
    """The message's level, else the text's own."""
    return F.coalesce(F.col("level"), F.col("text_level").cast("int"))


def enriched(entries: DataFrame, namespaces: DataFrame, dims: Dimensions) -> DataFrame:
    """All of it: one scan, joins with what the schemas declare, one projection."""
    out = entries.join(namespaces.select("namespace", "schema_name"), "namespace", "left")
    out = spans(samples(messages(out, dims), dims), dims)
    return out.withColumn("tags", F.coalesce("event_tags", "metric_tags", F.array().cast("array<string>"))).drop("event_tags", "metric_tags")


def texts(entries: DataFrame, schemas: list[Schema], language: str, fields: str = "fields") -> DataFrame:
    """entries (enriched; `fields`: a struct of typed event fields) with rendered: the event's template in a language (its schema's first one if that is unknown), or a text record's own text; null otherwise. Fields that the struct lacks leave the template as it is."""
    have = {f.name for f in entries.schema[fields].dataType.fields} if fields in entries.columns else set()
    out = F.when(F.col("kind") == "text", F.col("text"))
    for s in schemas:
        for e in s.events:
            if template := e.templates.get(s.language(language)):
                shown = rendered(template, e.fields, F.col(fields)) if {*e.fields} <= have else F.lit(template)
                out = out.when((F.col("kind") == "message") & (F.col("schema_name") == s.name) & (F.col("event") == e.id), shown)
    return entries.withColumn("rendered", out)


def json_fields(entries: DataFrame, schemas: list[Schema], fields: str = "fields") -> DataFrame:
    """entries with json: the event's declared fields."""
    out = F.lit(None).cast("string")
    for s in schemas:
        for e in s.events:
            if e.fields:
                out = F.when((F.col("kind") == "message") & (F.col("schema_name") == s.name) & (F.col("event") == e.id), as_json(F.col(fields), e.fields)).otherwise(out)
    return entries.withColumn("json", out)
