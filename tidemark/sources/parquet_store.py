"""A store on Parquet: partitioned records, and small tables for runs, hardware boots, namespaces and identity."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import BadName, Damaged, FromFuture, MissingMigration, SchemaMismatch, StoreError
from tidemark.functions.scalars import valid_component
from tidemark.model import ENTRIES
from tidemark.operators.reader import Store

CONTAINER_VERSION = 1
RUNS = "boot bigint, hw_boot bigint, init_us bigint"
HW_BOOTS = "hw_boot bigint, kernel_boot_id binary, anchor_ms bigint, anchor_source int, captured_us bigint"
NAMESPACES = "namespace string, schema_name string, protocol_version int"
IDENTITY = "container_version int, store_id bigint"
_SCHEMA = ", ".join(f"{c} {t}" for c, t in ENTRIES.items())


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet, which is an empty one. Files that can't be read are left out, so a corrupt table is one with fewer rows, or none; nothing is written."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder unless the target exists. Where the file system renames atomically, of two that try one succeeds."""
    jvm = spark._jvm
    path, kinds = jvm.org.apache.hadoop.fs.Path, getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    a, b = path(source), path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri() if b.toUri().getScheme() else jvm.java.io.File("/").toURI(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        context.rename(a, b, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        return False
    return True


def _write_identity(spark: SparkSession, path: str, store_id: int) -> None:
    spark.createDataFrame([(CONTAINER_VERSION, store_id)], IDENTITY).coalesce(1).write.parquet(path)


def read_store_id(spark: SparkSession, root: str) -> int | None:
    """The store's identity; None where there is none, or none that can be read."""
    found = _read(spark, f"{root}/identity", IDENTITY).first()
    return found["store_id"] if found else None


def create(spark: SparkSession, root: str) -> int:
    """Makes the store's identity unless it is there; returns it. Of several creators all get the first one's. A store of an earlier version gets this version and keeps its id; one of a later version is refused."""
    path, spare = f"{root}/identity", f"{root}/identity-{uuid.uuid4().hex}"
    if not _exists(spark, path):
        _write_identity(spark, spare, uuid.uuid4().int >> 66)
        _moved(spark, spare, path)
    found = _read(spark, path, IDENTITY).first()
    if found is None:
        raise Damaged(f"the identity of {root} can't be read")
    if found["container_version"] > CONTAINER_VERSION:
        raise FromFuture(f"container version {found['container_version']} is from the future")
    if found["container_version"] < CONTAINER_VERSION:
        _write_identity(spark, spare, found["store_id"])
        _moved(spark, path, f"{root}/identity-before-{uuid.uuid4().hex}")
        _moved(spark, spare, path)
    return found["store_id"]


def add_namespace(spark: SparkSession, root: str, name: str, schema) -> None:
    """Registers a namespace for a schema. A known one must have the same schema, of this version or one that its migrations start from."""
    if not spark.range(1).select(valid_component(F.lit(name))).first()[0]:
        raise BadName(f"{name!r} can't be a namespace")
    row = _read(spark, f"{root}/namespaces", NAMESPACES).where(F.col("namespace") == name).orderBy(F.desc("protocol_version")).first()
    if row and row["schema_name"] != schema.name:
        raise SchemaMismatch(f"{name} belongs to schema {row['schema_name']}")
    if row and row["protocol_version"] > schema.version:
        raise FromFuture(f"{name} has version {row['protocol_version']}, which is from the future")
    if row and row["protocol_version"] < min([schema.version, *(m.from_version for m in schema.migrations)]):
        raise MissingMigration(f"{name}: no migration starts from version {row['protocol_version']}")
    if row is None or row["protocol_version"] < schema.version:
        spark.createDataFrame([(name, schema.name, schema.version)], NAMESPACES).coalesce(1).write.mode("append").parquet(f"{root}/namespaces")


def save_runs(runs: DataFrame, hw_boots: DataFrame, root: str, version: str) -> None:
    """Writes the run tables as a new version; readers name the version that they use."""
    runs.coalesce(1).write.parquet(f"{root}/runs/{version}")
    hw_boots.coalesce(1).write.parquet(f"{root}/hw_boots/{version}")


def _segments(entries: DataFrame) -> DataFrame:
    """A row for each file of records: its place, path, size, times and ids. What a reader doesn't ask for isn't read."""
    rows = entries.select("namespace", "channel", "boot", "at_us", "event", "metric", "store_id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return rows.groupBy("namespace", "channel", "boot", "path", "size").agg(
        F.min("at_us").alias("base_us"), F.min("at_us").alias("min_us"), F.max("at_us").alias("max_us"), F.count("*").alias("n_records"),
        F.sort_array(F.collect_set("event")).alias("events"), F.sort_array(F.collect_set("metric")).alias("metrics"), F.min("store_id").alias("store_id"),
    )


def _damage(spark: SparkSession, folder: str, segments: DataFrame) -> DataFrame:
    """Files that are there and give no record."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.col("_metadata.file_path").alias("path"))
    lost = listed.join(segments.select("path").distinct(), "path", "left_anti")
    return lost.select("path", F.lit(0).cast("bigint").alias("offset"), F.lit("the file can't be read").alias("reason"))


def open_store(spark: SparkSession, root: str, version: str = "0") -> Store:
    """The store for reading; nothing is written. Missing or corrupt run tables are empty ones: records are then read without anchored time. Files of records that can't be read are damage, and the rest is read."""
    folder = f"{root}/entries"
    entries = _read(spark, folder, _SCHEMA)
    segments = damage = None
    if _exists(spark, folder):
        segments = _segments(entries)
        damage = _damage(spark, folder, segments)
    names = _read(spark, f"{root}/namespaces", NAMESPACES).groupBy("namespace").agg(F.max_by("schema_name", "protocol_version").alias("schema_name"), F.max("protocol_version").alias("protocol_version"))
    return Store(entries, names, _read(spark, f"{root}/runs/{version}", RUNS), _read(spark, f"{root}/hw_boots/{version}", HW_BOOTS), segments, damage, read_store_id(spark, root))


__all__ = ["StoreError", "add_namespace", "create", "open_store", "read_store_id", "save_runs"]
