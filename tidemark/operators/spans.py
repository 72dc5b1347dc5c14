"""Spans put together from their records, across namespaces. A span id is local to its run, so (boot, span) is the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import written


def spans(entries: DataFrame) -> DataFrame:
    """(boot, span, span_kind, parent, start_us, end_us, took_us): one row a span. Open spans have no end; ends without start have no kind. One aggregation instead of a self-join."""
    start, end = F.col("kind") == "span_start", F.col("kind") == "span_end"
    rows = entries.where(F.col("kind").isin("span_start", "span_end") & F.col("span").isNotNull() & (F.col("span") != 0))
    out = rows.groupBy("boot", "span").agg(
        F.min(F.when(start, F.col("span_kind"))).alias("span_kind"),
        F.min(F.when(start, F.nullif("parent", F.lit(0)))).alias("parent"),
        F.min(F.when(start, F.col("at_us"))).alias("start_us"),
        F.max(F.when(end, F.col("at_us"))).alias("end_us"),
    )
    return out.withColumn("took_us", F.col("end_us") - F.col("start_us"))


def of_spans(entries: DataFrame) -> DataFrame:
    """(boot, span, n_records, n_messages) of what happened inside each span."""
    rows = entries.where(~F.col("kind").isin("span_start", "span_end") & F.col("span").isNotNull() & (F.col("span") != 0))
    return rows.groupBy("boot", "span").agg(F.count("*").alias("n_records"), F.count(F.when(F.col("kind") == "message", 1)).alias("n_messages"))


def paths(table: DataFrame) -> DataFrame:
    """spans() with root and depth. Ancestors are found by doubling: equi-joins on (boot, span), each round written, until no row has an ancestor left. Rows that still have one after log2(rows) rounds lead into a cycle, which only damage makes: null root and depth."""
    out = written(table.withColumns({"up": F.col("parent"), "root": F.coalesce("parent", "span"), "depth": F.when(F.col("parent").isNull(), 0).otherwise(1)}))
    is_open = F.col("up").isNotNull()
    rounds = out.count().bit_length() + 1  # paths without a cycle are no longer than there are rows
    for _ in range(rounds):
        if out.where(is_open).isEmpty():
            break
        above = out.select("boot", F.col("span").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        out = written(out.join(above, ["boot", "up"], "left").withColumns({
            "root": F.coalesce("root2", "root"), "depth": F.col("depth") + F.coalesce("depth2", F.lit(0)), "up": F.col("up2"),
        }).drop("root2", "depth2", "up2"))
    return out.withColumns({c: F.when(~is_open, F.col(c)) for c in ("root", "depth")}).drop("up")


def recorded(works: DataFrame) -> DataFrame:
    """Span records of works (boot, namespace, schema_name, work, within, span_kind, start_us, end_us, seq): a span_start each, and a span_end where end_us is known. work names a span within its run and within the one that holds it (null: a root), maybe in another namespace; ids are allocated here. A parent that isn't there gives a root."""
    ids = allocated(works.withColumnRenamed("start_us", "at_us"))
    parents = ids.select("boot", F.col("work").alias("within"), F.col("span").alias("parent"))
    starts = ids.join(parents, ["boot", "within"], "left")
    common = ["boot", "namespace", "schema_name", "span", "seq"]
    first = starts.select(*common, "at_us", F.lit("span_start").alias("kind"), "span_kind", "parent")
    last = ids.where("end_us is not null").select(*common, F.greatest("at_us", "end_us").alias("at_us"), F.lit("span_end").alias("kind"), "span_kind", F.lit(None).cast("bigint").alias("parent"))
    return first.unionByName(last)


def allocated(starts: DataFrame) -> DataFrame:
    """starts (boot, namespace, at_us, seq) with span: ids from 1 on, unique in the run. Ranks are taken within a namespace and offset by the counts of those before it, so no task sorts a whole run."""
    sizes = starts.groupBy("boot", "namespace").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("boot").orderBy("namespace").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("boot", "namespace", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("boot", "namespace").orderBy("at_us", "seq"))
    return starts.withColumn("span", rank).join(sizes, ["boot", "namespace"]).withColumn("span", F.col("span") + F.col("__before")).drop("__before")
