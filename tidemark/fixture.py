"""The driver's tables as a store: events become records of two schemas on six runs; conversations become spans and texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import DEBUG, ERROR, INFO, TRACE, WARN
from tidemark.operators.reader import Store
from tidemark.operators.storage import footers
from tidemark.schema import Event, Metric, Range, Schema, Span, State, local_table

DAY_US = 86_400_000_000
RUN_US = 5 * DAY_US
EPOCH_US = 1_704_067_200_000_000


def _events(signup: int) -> tuple[Event, ...]:
    return (
        Event(1, "Click", DEBUG, tags=("ui",), templates={"en": "click {k} by {user_id}", "de": "Klick {k} von {user_id}"}, fields={"k": "int", "user_id": "bigint"}),
        Event(2, "View", TRACE, tags=("ui",), templates={"en": "view", "de": "Ansicht"}),
        Event(3, "Signup", signup, tags=("account",), templates={"en": "signup of {user_id:>6}", "de": "Anmeldung"}, fields={"user_id": "bigint"}),
        Event(4, "Fault", ERROR, "critical", ("fault",), {"en": "fault {{{k}}}", "de": "Fehler {k}"}, {"k": "int"}),
    )


_AMOUNT = Metric(1, "amount", "f64", "gauge", "EUR", "telemetry", ("money",), Range(None, 100), Range(None, 200))
RADIO = Schema("radio", 1, ("en", "de"), _events(INFO), (_AMOUNT, Metric(2, "link", "u64", "state", None, "telemetry", ("rf",), states=(State(0, "Los", "alarm"), State(1, "Sync", "warn"), State(2, "Lock")))), (Span(1, "Conversation"),))
MODEM = Schema("modem", 1, ("en", "de"), _events(WARN), (_AMOUNT, Metric(2, "rate", "u64", "gauge", "1/s", "telemetry", ("rf",))), (Span(1, "Conversation"),))
SCHEMAS = [RADIO, MODEM]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and samples of events, with schema_name, us (the original time), base_us (a segment a day) and fields."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    kind, u, k, t = F.col("event_type"), F.col("user_id") % 7, F.col("k"), F.col("us") - EPOCH_US
    boot = F.call_function("div", t, F.lit(RUN_US)).cast("bigint")
    sale = kind == "purchase"
    link = sale & (k % 4 == 0)
    e = e.select(
        F.col("event_id").alias("seq"), boot.alias("boot"), (t - boot * RUN_US).alias("at_us"), "us",
        F.when(u < 4, F.concat(F.lit("orc-radio-"), u.cast("string"))).otherwise(F.concat(F.lit("apt-modem-"), (u - 4).cast("string"))).alias("namespace"),
        F.when(u < 4, "radio").otherwise("modem").alias("schema_name"),
        F.when(kind == "error", "critical").when(sale, "telemetry").otherwise("default").alias("channel"),
        F.when(sale, "sample").otherwise("message").alias("kind"),
        F.when(kind == "click", F.when(k >= 95, 99).otherwise(1)).when(kind == "view", 2).when(kind == "signup", 3).when(kind == "error", 4).alias("event"),
        F.when(sale, F.when(k % 4 == 0, 2).otherwise(1)).alias("metric"),
        F.when(sale, F.when(link, "u64").otherwise("f64")).alias("vtype"),
        F.when(sale & ~link, F.col("value")).alias("v_f64"),
        F.when(link, (k % 5).cast("decimal(20,0)")).alias("v_u64"),
        F.when(~sale & (k % 3 == 0), F.col("user_id") + 1).alias("span"),
        F.struct("k", "user_id").alias("fields"),
    )
    e = e.withColumn("base_us", F.col("at_us") - F.col("at_us") % DAY_US)
    blank = {"payload": "binary", "span_kind": "int", "parent": "bigint", "v_f32": "float", "v_i64": "bigint", "v_bool": "boolean", "v_blob": "binary", "text_level": "tinyint", "target": "string", "text": "string", "ext": "binary"}
    return e.select("*", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a span of run 0 (its parent: the conversation with half its id), each turn a text inside it."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    span, at = F.col("conv_id") + 1, F.col("conv_id") * 1_000_000 + F.col("turn") * 1000
    common = [F.lit("apt-chat-0").alias("namespace"), F.lit("radio").alias("schema_name"), F.lit("default").alias("channel"), F.lit(0).cast("bigint").alias("boot"), span.alias("span")]
    turns = c.select(*common, at.alias("at_us"), F.lit("text").alias("kind"), F.when(F.col("role") == "system", WARN).otherwise(INFO).cast("tinyint").alias("text_level"), F.col("role").alias("target"), "text")
    ends = c.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    half = F.call_function("div", span, F.lit(2).cast("bigint"))
    first = ends.select(*common, (F.col("conv_id") * 1_000_000 + F.col("a") * 1000).alias("at_us"), F.lit("span_start").alias("kind"), half.alias("parent"), F.lit(1).alias("span_kind"))
    last = ends.select(*common, (F.col("conv_id") * 1_000_000 + F.col("b") * 1000).alias("at_us"), F.lit("span_end").alias("kind"))
    return turns.unionByName(first, allowMissingColumns=True).unionByName(last, allowMissingColumns=True)


def runs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Six runs on three hardware boots, of which the second has no anchor. anchor + init + at is the original time."""
    b = spark.range(6).withColumnRenamed("id", "boot")
    hw = F.call_function("div", F.col("boot"), F.lit(2).cast("bigint"))
    r = b.select("boot", hw.alias("hw_boot"), (1_000_000 + F.col("boot") % 2 * RUN_US).alias("init_us"))
    h = spark.range(3).select(F.col("id").alias("hw_boot"), F.lit(None).cast("binary").alias("kernel_boot_id"), F.when(F.col("id") != 1, 1_704_067_200_000 + F.col("id") * 864_000_000 - 1000).alias("anchor_ms"))
    return r, h


def segments(records: DataFrame) -> DataFrame:
    """Footers of a segment a day, with a nominal size of 8 bytes a record."""
    return footers(records).withColumn("size", F.col("n_records") * 8)


def store(spark: SparkSession, sf_dir: str) -> Store:
    records = entries(spark, sf_dir)
    names = local_table(spark, [(f"orc-radio-{i}", "radio") for i in range(4)] + [(f"apt-modem-{i}", "modem") for i in range(3)], {"namespace": pa.string(), "schema_name": pa.string()})
    return Store(records.drop("schema_name"), names, *runs(spark), segments=segments(records))
