"""What the operators share: scratch tables in the cluster's shared folder and exact ASCII text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import shared_folder, written  # noqa: F401

#: White space of the word and line rules: space and U+0009 to U+000D.
SPACE = r"[ \t-\r]"
#: Characters on which lower() does what lower-casing A-Z alone does.
_SAFE = "\\x00-\\x7F\\xA0-\\xBF\\xDF-\\xFF\\u2000-\\u206F"


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables on whatever file system holds them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, on whatever file system holds it; none where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() takes ASCII texts whole, and of others, where more cased characters occur, the runs between these."""
    runs = F.regexp_extract_all(text, F.lit(f"[{_SAFE}]+|[^{_SAFE}]+"), F.lit(0))
    mixed = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(f"^[{_SAFE}]"), F.lower(x)).otherwise(x)), "")
    return F.when((F.octet_length(text) > F.length(text)) & text.rlike(f"[^{_SAFE}]"), mixed).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """White-space separated words; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")
