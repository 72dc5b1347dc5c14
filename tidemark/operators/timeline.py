"""Runs and their anchors: retroactive UTC, anchor acceptance, registration, and which runs fit a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import plausible_utc, relative_us, utc_us
from tidemark.plans.query import BootTime, Query, Utc


def anchors(runs: DataFrame, hw_boots: DataFrame) -> DataFrame:
    """(boot, init_us, anchor_ms) of every run; anchor_ms is null where its hardware boot has none. One row a run: broadcast where small."""
    return runs.join(hw_boots.select("hw_boot", "anchor_ms"), "hw_boot", "left").select("boot", "init_us", "anchor_ms")


def with_utc(entries: DataFrame, anchored: DataFrame) -> DataFrame:
    """entries with utc_us and utc, which are never stored, as an anchor may come later than the records."""
    out = entries.join(anchored, "boot", "left")
    return out.withColumn("utc_us", utc_us(F.col("anchor_ms"), F.col("init_us"), F.col("at_us"))).withColumn("utc", F.timestamp_micros("utc_us")).drop("anchor_ms", "init_us")


def accepted_syncs(syncs: DataFrame) -> DataFrame:
    """syncs (hw_boot, arrival, source, utc_ms) with accepted: plausible, and of a source at least as good as any accepted before."""
    order = Window.partitionBy("hw_boot").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    usable = plausible_utc(F.col("utc_ms"))
    best = F.max(F.when(usable, F.col("source"))).over(order)
    return syncs.withColumn("accepted", usable & (F.col("source") == best))


def final_anchors(syncs: DataFrame) -> DataFrame:
    """(hw_boot, anchor_ms, source): the last of the best-sourced plausible syncs. An aggregation without a window: it combines before it shuffles."""
    return syncs.where(plausible_utc(F.col("utc_ms"))).groupBy("hw_boot").agg(F.max_by(F.struct("utc_ms", "source"), F.struct("source", "arrival")).alias("a")).select("hw_boot", F.col("a.utc_ms").alias("anchor_ms"), "a.source")


def registered(runs: DataFrame, hw_boots: DataFrame, kernel_boot_id: bytes, init_us: int) -> tuple[DataFrame, DataFrame]:
    """runs and hw_boots with a new run: its ids are one more than the largest; a known kernel boot id is used again."""
    spark = runs.sparkSession
    known = hw_boots.where(F.col("kernel_boot_id") == F.lit(kernel_boot_id)).agg(F.max("hw_boot")).first()[0]
    top_boot, top_hw = runs.agg(F.max("boot")).first()[0], hw_boots.agg(F.max("hw_boot")).first()[0]
    hw = known if known is not None else (-1 if top_hw is None else top_hw) + 1
    new = spark.createDataFrame([((-1 if top_boot is None else top_boot) + 1, hw, init_us)], "boot bigint, hw_boot bigint, init_us bigint")
    runs = runs.unionByName(new, allowMissingColumns=True)
    if known is None:
        hw_boots = hw_boots.unionByName(spark.createDataFrame([(hw, kernel_boot_id)], "hw_boot bigint, kernel_boot_id binary"), allowMissingColumns=True)
    return runs, hw_boots


def retained(runs: DataFrame, hw_boots: DataFrame, segments: DataFrame, current: int) -> tuple[DataFrame, DataFrame]:
    """Runs that still have segments, or are current; and the hardware boots of those."""
    live = segments.select("boot").union(runs.where(F.col("boot") == current).select("boot")).distinct()
    runs = runs.join(live, "boot", "left_semi")
    return runs, hw_boots.join(runs.select("hw_boot").distinct(), "hw_boot", "left_semi")


def run_bounds(anchored: DataFrame, q: Query) -> DataFrame:
    """anchored with fit (in, outside or unanchored) and, for runs that fit, low_us and high_us (null: open)."""
    boot = F.col("boot")

    def bound(at: BootTime | Utc | None, lower: bool) -> tuple[Column, Column]:
        """Whether the run lies outside, and its bound."""
        none = F.lit(None).cast("bigint")
        if at is None:
            return F.lit(False), none
        if isinstance(at, BootTime):
            return (boot < at.boot if lower else boot > at.boot), F.when(boot == at.boot, F.lit(at.at_us).cast("bigint"))
        us = relative_us(F.lit(at.us).cast("bigint"), F.col("anchor_ms"), F.col("init_us"))
        # Before the run's start a lower bound is open, and an upper one leaves nothing.
        return (F.lit(False) if lower else us.isNull()), us

    low_out, low = bound(q.start, True)
    high_out, high = bound(q.end, False)
    unanchored = F.col("anchor_ms").isNull() if q.anchored_only else F.lit(False)
    fit = F.when(unanchored, "unanchored").when(low_out | high_out, "outside").otherwise("in")
    return anchored.withColumn("fit", fit).withColumn("low_us", F.when(F.col("fit") == "in", low)).withColumn("high_us", F.when(F.col("fit") == "in", high))


def bands(anchored: DataFrame, q: Query, most: int = 32) -> list[Column]:
    """Predicates on (boot, at_us) that together keep whatever a wall-clock window may select, each for a scan of its own: runs with a lower bound and runs without one. They name at most `most` bands of neighbouring runs, so that their size doesn't follow the number of runs; the exact bound is wall_window()'s."""
    fit = run_bounds(anchored, q).where("fit = 'in'").withColumn("low_us", F.when(F.col("low_us") > 0, F.col("low_us")))
    ends = fit.agg(F.min("boot").alias("a"), F.max("boot").alias("b")).first()  # two numbers
    if ends["a"] is None:
        return []
    width = -(-(ends["b"] - ends["a"] + 1) // most)
    band = F.call_function("div", F.col("boot") - ends["a"], F.lit(width).cast("bigint"))
    bounded = F.col("low_us").isNotNull().alias("bounded")
    every = lambda c: F.count(c) == F.count("*")
    rows = fit.groupBy(band.alias("band"), bounded).agg(
        F.min("boot").alias("a"), F.max("boot").alias("b"), F.min("low_us").alias("low"), F.when(every("high_us"), F.max("high_us")).alias("high")
    ).collect()
    out = []
    for part in (False, True):
        merged: list[list] = []  # bands one after another with the same bounds are one
        for r in sorted((r for r in rows if r.bounded == part), key=lambda r: r.a):
            if merged and merged[-1][2:] == [r.low, r.high]:
                merged[-1][1] = r.b
            else:
                merged.append([r.a, r.b, r.low, r.high])
        if merged:
            out.append(reduce(Column.__or__, (_band(*m) for m in merged)))
    return out


def _band(a: int, b: int, low: int | None, high: int | None) -> Column:
    out = F.col("boot") == a if a == b else F.col("boot").between(a, b)
    if low is not None:
        out = out & (F.col("at_us") >= low)
    return out if high is None else out & (F.col("at_us") <= high)


def unanchored_boots(records: DataFrame, anchored: DataFrame) -> DataFrame:
    """Runs of records that have no anchor (also those that no run table knows), each once, in order."""
    known = anchored.where("anchor_ms is not null").select("boot")
    return records.select("boot").distinct().join(known, "boot", "left_anti").orderBy("boot")
