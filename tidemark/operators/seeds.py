"""Last-known states, and what a state holds between samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("namespace", "channel", "metric")
SLICE_US = 6 * 3_600_000_000


def last_states(samples: DataFrame) -> DataFrame:
    """The latest sample of each series, as an aggregation: every task keeps one row a series before anything is shuffled."""
    row = F.struct(*samples.columns)
    return samples.groupBy(*SERIES).agg(F.max_by(row, F.struct("boot", "at_us", "seq")).alias("row")).select("row.*")


def _with_neighbour(samples: DataFrame, slice_us: int, step: int, fields: list[str]) -> DataFrame:
    """samples with __other: fields of the next (step 1) or previous (step -1) sample of the series in the run. Neighbours are found within slices of time and, over the slices' own ends, from one slice to the next, so that no task takes a whole series. Samples of one time follow each other by channel and seq; one without namespace, metric or run has neighbours in its own slice only."""
    slice_of = F.call_function("div", F.col("at_us"), F.lit(slice_us).cast("bigint"))
    place, row, series = F.struct("at_us", "channel", "seq"), F.struct(*fields), ["namespace", "metric", "boot"]
    rows = samples.withColumn("__slice", slice_of)
    nearest = F.min_by(row, place) if step > 0 else F.max_by(row, place)
    ends = rows.groupBy(*series, "__slice").agg(nearest.alias("__end"))
    ends = ends.select(*series, "__slice", F.lead("__end", step).over(Window.partitionBy(*series).orderBy("__slice")).alias("__beyond"))
    order = Window.partitionBy(*series, "__slice").orderBy("at_us", "channel", "seq")
    return rows.join(ends, [*series, "__slice"], "left").withColumn("__other", F.coalesce(F.lead(row, step).over(order), "__beyond"))


def holding(samples: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """samples with until_us: when the next sample of the series in the run replaces the value (null: the last one)."""
    return _with_neighbour(samples, slice_us, 1, ["at_us"]).select(*samples.columns, F.col("__other.at_us").alias("until_us"))


def derivative(samples: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """samples (with number) with delta and delta_us from the previous sample of the series in the run, for counters."""
    rows = _with_neighbour(samples, slice_us, -1, ["at_us", "number"])
    return rows.select(*samples.columns, (F.col("number") - F.col("__other.number")).alias("delta"), (F.col("at_us") - F.col("__other.at_us")).alias("delta_us"))


def rolled_up(samples: DataFrame, bucket_us: int) -> DataFrame:
    """(namespace, metric, boot, bucket_us, n, low, high, total) per bucket of time."""
    start = F.col("at_us") - F.col("at_us") % bucket_us
    return samples.groupBy("namespace", "metric", "boot", start.alias("bucket_us")).agg(
        F.count("number").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.sum("number").alias("total")
    )
