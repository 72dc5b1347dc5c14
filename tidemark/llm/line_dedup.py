"""Line dedup over levelled sorted runs of line hashes.

The run store is a log-structured set of line keys. A run is a Parquet table, bucketed and sorted by a 128-bit key hash, that
maps each key to the document that owns it (the first that held it). A batch of documents is aggregated to its distinct keys,
merge-anti-joined against every run (the runs' side needs no shuffle: its buckets are the join's partitions), and what no run
holds becomes a run of level 0. `fanout` runs of a level are compacted into one of the next, so a key meets few runs.

At scale: keys are pre-aggregated before any join, so a line that a third of all documents share is one row of a run; the one
join of line occurrences (with the keys that lose lines) is a plain equi-join that adaptive execution can split. Nothing is
collected; each step is written to the shared folder.

Defined results: a null or empty text is one empty line; a row without doc_id keeps its lines and owns none; rows that share
a doc_id are one document; batches are document ranges in ascending order, so the owner is the smallest doc_id; an empty table
gives an empty table; other columns pass through unless they carry the name of a result column, which then replaces them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, children, drop, shared_folder, shuffle_partitions, written

MIN_CODE_POINTS = 10
KEY = ["h1", "h2"]


def line_key(lowered: Column) -> Column:
    """Key of a line whose A-Z are lower-cased already."""
    return F.btrim(lowered, F.lit(" \t\n\x0b\x0c\r"))


class LineRuns:
    """The levelled runs: key hash -> owner. Each is a subfolder of `folder` that names its level and number of buckets; a run whose writing broke off has no success mark and isn't opened. Without a folder the runs go when they are closed."""

    def __init__(self, spark: SparkSession, fanout: int = 3, folder: str | None = None) -> None:
        self.spark, self.fanout, self.stays = spark, fanout, folder is not None
        self.folder = (folder or shared_folder(spark)).rstrip("/")
        self.levels: list[list[tuple[str, str]]] = []
        for run in sorted(children(spark, self.folder)):
            level, buckets, number = run.split("-")
            if "_SUCCESS" in children(spark, f"{self.folder}/{run}"):
                name, path = f"line_run_{number}_{uuid.uuid4().hex[:8]}", f"{self.folder}/{run}"
                spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
                self._hold(int(level), name, path)

    def _hold(self, level: int, name: str, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _write(self, rows: DataFrame, level: int) -> None:
        number, n = uuid.uuid4().hex, shuffle_partitions(self.spark)
        name, path = f"line_run_{number}", f"{self.folder}/{level}-{n}-{number}"
        rows.repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self._hold(level, name, path)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def owners(self, keys: DataFrame) -> DataFrame:
        """keys with `held`: the owner that a run has for the key, else null."""
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.withColumnRenamed("owner", f"__o{i}"), KEY, "left")
        found = [c for c in keys.columns if c.startswith("__o")]
        return keys.withColumn("held", F.coalesce(F.lit(None).cast("bigint"), *found)).drop(*found)

    def add(self, fresh: DataFrame) -> None:
        """fresh: (h1, h2, owner) of keys that no run holds. Compacts each level that is full. Where an earlier compaction broke off, a key may be in two runs, with the same owner; it is one row again in the next."""
        self._write(fresh, 0)
        level = 0
        while level < len(self.levels):
            if len(runs := self.levels[level]) >= self.fanout:
                rows = reduce(DataFrame.unionByName, [self.spark.table(name) for name, _ in runs])
                self._write(rows.groupBy(*KEY).agg(F.min("owner").alias("owner")), level + 1)
                self.levels[level] = []
                self._remove(runs)
            level += 1

    def _remove(self, runs: list[tuple[str, str]], files: bool = True) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if files:
                drop(self.spark, path)

    def close(self) -> None:
        for runs in self.levels:
            self._remove(runs, not self.stays)
        self.levels = []


def add_batch(runs: LineRuns, lines: DataFrame) -> DataFrame:
    """Takes a batch's occurrences (doc_id, tag, pos, h1, h2) into the runs; returns those (doc_id, tag, pos) that are lost."""
    keys = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    keys = written(runs.owners(keys).withColumn("owner", F.coalesce("held", "first")))
    runs.add(keys.where("held is null").select(*KEY, "owner"))
    shared = keys.where("last > owner").select(*KEY, "owner")
    return lines.join(shared, KEY).where("doc_id > owner").select("doc_id", "tag", "pos")


def occurrences(docs: DataFrame) -> DataFrame:
    """Lines of docs (doc_id, text) whose key is long enough: (doc_id, tag, pos, h1, h2). tag: a hash of the text, as rows may share a doc_id."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= MIN_CODE_POINTS)
    return keys.select("doc_id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dedup(docs: DataFrame, batches: int = 4, fanout: int = 3, folder: str | None = None) -> DataFrame:
    """docs with text replaced by its kept lines, plus n_lines and n_dropped. Needs doc_id and text. folder: where runs stand between jobs (one job at a time); a later job's documents then also lose the lines that an earlier job's document with a smaller doc_id owns, and a job that failed can be run again."""
    spark = docs.sparkSession
    body = docs.withColumn("text", F.coalesce("text", F.lit("")))
    bounds = sorted(set(body.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)))
    number = reduce(lambda c, b: c + (F.col("doc_id") > F.lit(int(b))).cast("int"), bounds, F.lit(0))
    path = shared_folder(spark)
    lines = occurrences(body.select("doc_id", "text")).withColumn("batch", number)
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    runs = LineRuns(spark, fanout, folder)
    try:
        lost = [add_batch(runs, lines.where(F.col("batch") == k).drop("batch")) for k in range(len(bounds) + 1)]
    finally:
        runs.close()
    lost = reduce(DataFrame.unionByName, lost).groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("__pos"))
    lost = lost.select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "__pos")

    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    # The line array crosses the shuffle, so no expression splits the text again.
    rows = body.select(*rest, F.xxhash64("text").alias("__own"), F.split("text", "\n").alias("__lines"))
    rows = rows.join(lost, (F.col("doc_id") == F.col("__doc")) & (F.col("__own") == F.col("__tag")), "left")
    n = F.size("__lines")
    kept = F.when(F.col("__pos").isNull(), F.col("__lines")).otherwise(
        F.transform(F.array_except(F.when(n > 0, F.sequence(F.lit(0), n - 1)), F.col("__pos")), lambda i: F.get(F.col("__lines"), i))
    )
    return rows.select(
        *(F.col(c) for c in rest),
        F.array_join(kept, "\n").alias("text"),
        n.cast("bigint").alias("n_lines"),
        F.when(F.col("__pos").isNull(), 0).otherwise(F.size("__pos")).cast("bigint").alias("n_dropped"),
    )
