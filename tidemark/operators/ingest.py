"""The write side: validation, routing, monotone time, reports in the stream itself, and partitioned Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import ERROR, as_entries
from tidemark.schema import Dimensions

PARTITIONS = ("namespace", "channel", "boot")
OWN_TARGET = "tidemark"
SLICE_US = 6 * 3_600_000_000


@dataclass(frozen=True)
class ChannelPolicy:
    """Storage of a channel. critical: small, immediate and waited for."""

    budget: int
    segment_size: int
    flush_ms: int = 1000
    immediate: bool = False

    @classmethod
    def of(cls, budget: int) -> ChannelPolicy:
        return cls(budget, min(max(budget // 256, 4 << 20), 256 << 20))

    @classmethod
    def critical(cls, budget: int) -> ChannelPolicy:
        return cls(budget, min(max(budget // 256, 4 << 20), 256 << 20), 0, True)

    def __post_init__(self) -> None:
        if self.budget < 2 * self.segment_size:
            raise ValueError("a budget must hold at least two segments")

    @property
    def max_segments(self) -> int:
        return self.budget // self.segment_size


def routed(records: DataFrame, dims: Dimensions) -> DataFrame:
    """records (with schema_name) with channel: the declared class of their event, metric or span; text goes by level. Null where nothing is declared."""
    def store(table: DataFrame, key: str, name: str) -> DataFrame:
        return table.select("schema_name", key, F.col("store").alias(name))

    out = records.join(store(dims.events, "event", "__e"), ["schema_name", "event"], "left")
    out = out.join(store(dims.metrics, "metric", "__m"), ["schema_name", "metric"], "left").join(store(dims.spans, "span_kind", "__s"), ["schema_name", "span_kind"], "left")
    text = F.when(F.col("text_level") >= ERROR, "critical").otherwise("default")
    kind = F.col("kind")
    channel = F.when(kind == "message", F.col("__e")).when(kind == "sample", F.col("__m")).when(kind.isin("span_start", "span_end"), F.coalesce("__s", F.lit("default"))).when(kind == "text", text).otherwise("default")
    return out.withColumn("channel", channel).drop("__e", "__m", "__s")


def violations(records: DataFrame, dims: Dimensions) -> DataFrame:
    """records with violation: unknown_event, unknown_metric, wrong_type, or null for those that may be written."""
    events = dims.events.select("schema_name", "event", F.lit(True).alias("__e"))
    metrics = dims.metrics.select("schema_name", "metric", "declared_vtype")
    out = records.join(events, ["schema_name", "event"], "left").join(metrics, ["schema_name", "metric"], "left")
    kind = F.col("kind")
    # A state's code may come unsigned for any integral type.
    fits = (F.col("vtype") == F.col("declared_vtype")) | ((F.col("vtype") == "u64") & F.col("declared_vtype").isin("bool", "i64"))
    found = F.when((kind == "message") & F.col("__e").isNull(), "unknown_event").when((kind == "sample") & F.col("declared_vtype").isNull(), "unknown_metric").when((kind == "sample") & ~fits, "wrong_type")
    return out.withColumn("violation", found).drop("__e", "declared_vtype")


def announcements(rejected: DataFrame) -> DataFrame:
    """(namespace, violation, n): each kind of violation once a namespace."""
    return rejected.groupBy("namespace", "violation").agg(F.count("*").alias("n"))


def unknown_spans(records: DataFrame, dims: Dimensions) -> DataFrame:
    """(namespace, violation, n): undeclared span kinds, which are reported but kept."""
    starts = records.where((F.col("kind") == "span_start") & F.col("schema_name").isNotNull())
    lost = starts.join(dims.spans.select("schema_name", "span_kind"), ["schema_name", "span_kind"], "left_anti")
    return announcements(lost.withColumn("violation", F.lit("unknown_span_kind")))


def drop_notices(dropped: DataFrame) -> DataFrame:
    """Text records that say how many records each channel lost, at the last loss."""
    lost = dropped.groupBy(*PARTITIONS).agg(F.count("*").alias("n"), F.max("at_us").alias("at_us"))
    return lost.select(*PARTITIONS, "at_us", F.lit("text").alias("kind"), F.lit(ERROR).cast("tinyint").alias("text_level"), F.lit(OWN_TARGET).alias("target"), F.concat(F.col("n").cast("string"), F.lit(" records dropped")).alias("text"))


def monotone(records: DataFrame, arrivals: int = 1 << 20) -> DataFrame:
    """records with at_us raised to the latest time before it in the channel's run, in order of arrival (seq). Late records move forward; none is lost. The maximum runs within stretches of that many arrivals and, over their own maxima, from one to the next, so that no task takes a whole run."""
    stretch = F.call_function("div", F.col("seq"), F.lit(arrivals).cast("bigint"))
    tops = records.groupBy(*PARTITIONS, stretch.alias("__stretch")).agg(F.max("at_us").alias("__top"))
    before = F.max("__top").over(Window.partitionBy(*PARTITIONS).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.withColumn("__before", before).drop("__top")
    order = Window.partitionBy(*PARTITIONS, "__stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = records.withColumn("__stretch", stretch).join(tops, [*PARTITIONS, "__stretch"])
    return rows.withColumn("at_us", F.greatest(F.max("at_us").over(order), "__before")).select(records.columns)


def append(records: DataFrame, folder: str, compression: str = "zstd", slice_us: int = SLICE_US) -> None:
    """Appends records to the store's Parquet: a file for each slice of time of a channel's run, so that no task writes a whole run, sorted by time for row-group pruning."""
    rows = as_entries(records).withColumn("__slice", F.call_function("div", F.col("at_us"), F.lit(slice_us).cast("bigint")))
    rows = rows.repartition(*PARTITIONS, "__slice").sortWithinPartitions(*PARTITIONS, "at_us", "seq").drop("__slice")
    rows.write.mode("append").partitionBy(*PARTITIONS).option("compression", compression).parquet(folder)


def ingest(records: DataFrame, dims: Dimensions, folder: str) -> DataFrame:
    """Writes what the schemas allow, with the version of the schema that it was written under; returns what they don't allow, with its violation."""
    if "protocol_version" in records.columns:
        records = records.drop("protocol_version")
    records = records.join(dims.versions.withColumnRenamed("version", "protocol_version"), "schema_name", "left")
    judged = violations(records, dims)
    append(monotone(routed(judged.where("violation is null").drop("violation", "channel"), dims)), folder)
    return judged.where("violation is not null")


def counters(records: DataFrame, dims: Dimensions) -> DataFrame:
    """One row of counts by kind, of rejected records and of bytes of payload."""
    judged = violations(records, dims)
    by_kind = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("message", "sample", "text", "span_start", "span_end", "ext")]
    return judged.agg(F.count("*").alias("n_records"), *by_kind, F.count("violation").alias("n_rejected"))
