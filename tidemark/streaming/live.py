"""Live records: a stream over a store's files, the monotone clamp with state, and counts in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.model import ENTRIES


def live(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Records as they arrive in a store's Parquet folder."""
    schema = ", ".join(f"{c} {t}" for c, t in ENTRIES.items())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def monotone(records: DataFrame, runs: int = 16) -> DataFrame:
    """The streaming form of ingest.monotone: late records move up to the latest time of their channel's run, over batches too. State: that time for the newest `runs` runs of each (namespace, channel), as a device is in one run at a time; a run older than these is clamped within its batch only."""
    schema = records.schema

    def clamp(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(batches).sort_values(["boot", "seq"], kind="stable")
        rows["at_us"] = rows["at_us"].clip(lower=rows["boot"].map(last).fillna(0).astype("int64")).groupby(rows["boot"]).cummax()
        last |= rows.groupby("boot")["at_us"].max().to_dict()
        held = sorted(int(b) for b in last)[-runs:]
        state.update((held, [int(last[b]) for b in held]))
        yield rows

    return records.groupBy("namespace", "channel").applyInPandasWithState(clamp, schema, "boots array<bigint>, lasts array<bigint>", "append", GroupStateTimeout.NoTimeout)


def counts(records: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Records per namespace and kind in windows of utc, with a watermark for late ones."""
    return records.withWatermark("utc", lateness).groupBy(F.window("utc", window), "namespace", "kind").agg(F.count("*").alias("n"))
