"""Segments: their footers, budgets, gaps and integrity, computed from records and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = ("namespace", "channel", "boot", "base_us")


def footers(records: DataFrame) -> DataFrame:
    """A row for each segment of records (which carry base_us): times, counts, and the sorted ids of events and metrics."""
    return records.groupBy(*SEGMENT).agg(
        F.min("at_us").alias("min_us"),
        F.max("at_us").alias("max_us"),
        F.count("*").alias("n_records"),
        F.sort_array(F.collect_set("event")).alias("events"),
        F.sort_array(F.collect_set("metric")).alias("metrics"),
    )


def in_window(segments: DataFrame, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Segments that may hold records from start_us to end_us of their run. A base is its segment's first time, so one after end_us holds none; one is all behind only if the next of its channel and run begins strictly before start_us (times may repeat), so a run's last segment stays."""
    following = F.lead("base_us").over(Window.partitionBy("namespace", "channel", "boot").orderBy("base_us"))
    out = segments.withColumn("__next", following)
    if end_us is not None:
        out = out.where(F.col("base_us") <= end_us)
    if start_us is not None:
        out = out.where(~F.coalesce(F.col("__next") < start_us, F.lit(False)))
    return out.drop("__next")


def touches(segments: DataFrame, events: list[int] | None = None, metrics: list[int] | None = None) -> Column:
    """Whether a segment may hold any of these events or metrics; without sets (an unsealed one) it may."""
    def any_of(c: str, ids: list[int]) -> Column:
        return F.coalesce(F.arrays_overlap(c, F.array(*(F.lit(i) for i in ids))), F.lit(True))

    found = [any_of(c, ids) for c, ids in (("events", events), ("metrics", metrics)) if ids is not None]
    out = F.lit(not found)
    for x in found:
        out = out | x
    return out


def over_budget(segments: DataFrame, budget: Column) -> DataFrame:
    """Segments to delete so that each channel keeps to its budget: the oldest ones, never the newest, which is being written."""
    newest_first = Window.partitionBy("namespace", "channel").orderBy(F.desc("boot"), F.desc("base_us"))
    kept = F.sum("size").over(newest_first.rowsBetween(Window.unboundedPreceding, 0))
    out = segments.withColumn("__kept", kept).withColumn("__age", F.row_number().over(newest_first))
    return out.where((F.col("__kept") > budget) & (F.col("__age") > 1)).drop("__kept", "__age")


def gaps(blocks: DataFrame) -> DataFrame:
    """blocks (segment columns, offset, block_seq) after which numbers are missing: with next_seq."""
    order = Window.partitionBy(*SEGMENT).orderBy("offset")
    return blocks.withColumn("next_seq", F.lead("block_seq").over(order)).where("next_seq <> block_seq + 1")


def deltas(records: DataFrame) -> DataFrame:
    """records with delta_us from the previous record of the segment (0 for the first; time that runs back counts as 0)."""
    order = Window.partitionBy(*SEGMENT).orderBy("seq")
    return records.withColumn("delta_us", F.coalesce(F.greatest(F.col("at_us") - F.lag("at_us").over(order), F.lit(0)), F.lit(0)))


def absolute(records: DataFrame) -> DataFrame:
    """The inverse: at_us from base_us (the segment's first time) and delta_us."""
    order = Window.partitionBy(*SEGMENT).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("at_us", F.col("base_us") + F.sum("delta_us").over(order))
