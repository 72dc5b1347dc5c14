"""URL filters: explicit rules first, then a path-template tree judged by smoothed labelled purity.

Rules meet hosts in an equi-join on host suffixes, so a list of a million hosts is a table and not a plan. They give verdicts and,
in doing so, labels. The tree is built per host over path *shapes* (runs of digits become #), which are aggregated first: a host
with a third of all pages is a few shapes. Level by level, a node with many rare children turns them into a wildcard, and
labelled children are put in order of their block rates: neighbours whose rates don't differ by a two-proportion z test (each
with enough labels to tell) merge into one branch. Other children stay branches of their own. A node that holds one shape has
no more branches, and its shape's rest is its template; so levels end where paths do, or before. What all shapes of a node begin with is taken in one step. A template's purity is its
share of block labels, smoothed towards the same template's share over all hosts and that towards the overall share. Merged
branches differ from host to host, so templates with one, and hosts without labels, are smoothed towards the overall share
only. A template without any label in its host is undecided and allowed. Built-in expressions, aggregations and equi-joins only.

Defined results: a null url, or one without ://, has an empty host and path and no rule, and is judged by the empty
template; of rules of one length that fit the first by name holds; repeated rows are judged alike; an empty table gives an
empty table; other columns pass through unless they carry the name of a result column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written

RESULT = ("host", "path", "rule", "verdict", "template", "purity")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    prefix: str  # host and path, as in example.com/en/


@dataclass(frozen=True)
class TreeSettings:
    """wildcard: a node with at least that many children, of at most `rare` pages each on average, gets a wildcard. z: below it two rates are alike. least: labels from which a branch's rate can be compared. weight: pages that a prior counts for. block_from: purity from which a template is rejected."""

    wildcard: int = 20
    rare: float = 5.0
    z: float = 1.96
    least: int = 5
    weight: float = 5.0
    block_from: float = 0.85


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """(verdict, prefix) of rules."""
    return spark.createDataFrame([(r.verdict, r.prefix) for r in rules], "verdict string, prefix string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of those hosts that some rule (verdict, prefix) fits: an array of (path, verdict, prefix), longest prefix first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    own = F.split("prefix", "/", 2)
    rules = rules.select(own[0].alias("suffix"), F.struct((-F.length("prefix")).alias("order"), "prefix", "verdict", F.concat(F.lit("/"), F.coalesce(F.get(own, F.lit(1)), F.lit(""))).alias("path")).alias("rule"))
    each = hosts.select("host", F.explode(suffixes).alias("suffix")).join(rules, "suffix")
    return each.groupBy("host").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def shape(path: Column) -> Column:
    """Path segments with runs of digits as #."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"[0-9]+", "#"), "/", -1)


def templates(shapes: DataFrame, s: TreeSettings = TreeSettings()) -> DataFrame:
    """shapes (host, segments, pages, labels, blocks) with `template`, grown branching by branching until no node holds two shapes."""
    node, ready = ["host", "template"], []
    tree = shapes.withColumns({"template": F.lit(""), "level": F.lit(0)})
    while True:
        nodes = tree.groupBy(*node).agg((F.count("*") == 1).alias("single"), F.min("segments").alias("low"), F.max("segments").alias("high"))
        # What the first and the last shape of a node begin with all of its shapes begin with: no branching there.
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        nodes = nodes.select(*node, "single", F.when(differ > 0, differ - 1).otherwise(F.size("low")).alias("common"))
        tree = tree.join(nodes, node)
        until = F.when(F.col("single"), F.size("segments")).otherwise(F.greatest("level", "common"))
        taken = F.when(until > F.col("level"), F.concat("template", F.lit("/"), F.array_join(F.slice("segments", F.col("level") + 1, until - F.col("level")), "/"))).otherwise(F.col("template"))
        tree = tree.withColumns({"template": taken, "level": until}).drop("single", "common")
        tree = written(tree.withColumn("over", F.size("segments") <= F.col("level")))
        ready.append(tree.where("over").drop("over", "level"))
        tree = tree.where("not over").drop("over")
        if tree.isEmpty():
            return reduce(DataFrame.unionByName, ready)
        tree = _stepped(tree.withColumn("part", F.get("segments", F.col("level"))), s).withColumn("level", F.col("level") + 1)


def _stepped(tree: DataFrame, s: TreeSettings) -> DataFrame:
    """tree with part, the next segment, taken into the template: as it is, as a wildcard or as a merged branch."""
    node = ["host", "template"]
    kids = tree.groupBy(*node, "part").agg(*(F.sum(c).alias(c) for c in ("pages", "labels", "blocks")))
    nodes = kids.groupBy(*node).agg(F.count("*").alias("n_kids"), F.sum("pages").alias("all_pages"))
    kids = kids.join(nodes, node).withColumn("variable", (F.col("n_kids") >= s.wildcard) & (F.col("all_pages") <= s.rare * F.col("n_kids")))
    told = kids.where(~F.col("variable") & (F.col("labels") >= s.least)).withColumn("rate", F.col("blocks") / F.col("labels"))
    order = Window.partitionBy(*node).orderBy("rate", "part")
    labels, blocks = F.lag("labels").over(order), F.lag("blocks").over(order)
    both = (F.col("blocks") + blocks) / (F.col("labels") + labels)
    error = F.sqrt(both * (1 - both) * (1 / F.col("labels") + 1 / labels))
    told = told.withColumn("breaks", F.when(F.col("rate") - blocks / labels <= s.z * error, 0).otherwise(1))
    told = told.withColumn("branch", F.sum("breaks").over(order))
    merged = told.groupBy(*node, "branch").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1")
    merged = told.join(merged, [*node, "branch"]).select(*node, "part", F.concat(F.lit("~"), "first").alias("branch"))
    steps = kids.join(merged, [*node, "part"], "left").select(*node, "part", F.when(F.col("variable"), "*").otherwise(F.coalesce("branch", "part")).alias("step"))
    return tree.join(steps, [*node, "part"]).withColumn("template", F.concat("template", F.lit("/"), "step")).drop("step", "part")


def judge(pages: DataFrame, rules: list[UrlRule] | DataFrame, settings: TreeSettings = TreeSettings(), url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, template and purity. rules: a list, or a table (verdict, prefix)."""
    host, path = host_and_path(F.col(url))
    rest = [c for c in pages.columns if c not in RESULT]
    rows = pages.select(*rest, host.alias("host"), path.alias("path"))
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    # Written first: where hosts with rules are few, as their size then shows, pages needn't be shuffled to them.
    known = written(rules_by_host(rows.select("host").distinct(), table)).select(F.col("host").alias("__of"), F.col("rules").alias("__rules"))
    rows = rows.join(known, F.col("host") == F.col("__of"), "left")
    rows = rows.withColumn("__rule", F.get(F.filter("__rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))).drop("__of", "__rules").withColumn("__segments", shape(F.col("path")))
    label = F.col("__rule.verdict")
    shapes = rows.groupBy("host", F.col("__segments").alias("segments")).agg(
        F.count("*").alias("pages"), F.count(label).alias("labels"), F.count(F.when(label == "block", 1)).alias("blocks")
    )
    tree = templates(written(shapes), settings)
    total = tree.agg(F.sum("blocks"), F.sum("labels")).first()  # two numbers
    prior, w = (total[0] or 0) / max(total[1] or 0, 1), settings.weight
    sums = [F.sum("labels").alias("labels"), F.sum("blocks").alias("blocks")]
    everywhere = tree.groupBy("template").agg(*sums).select("template", ((F.col("blocks") + w * prior) / (F.col("labels") + w)).alias("common"))
    hosts = tree.groupBy("host").agg(F.sum("labels").alias("host_labels"))
    own = tree.groupBy("host", "template").agg(*sums).join(everywhere, "template").join(hosts, "host")
    alone = F.col("template").contains("/~") | (F.col("host_labels") == 0)
    base = F.when(alone, F.lit(prior)).otherwise(F.col("common"))
    own = own.select("host", "template", F.col("labels").alias("__evidence"), ((F.col("blocks") + w * base) / (F.col("labels") + w)).alias("purity"))
    judged = tree.select("host", "segments", "template").join(own, ["host", "template"]).select(F.col("host").alias("__host"), F.col("segments").alias("__key"), "template", "purity", "__evidence")
    rows = rows.join(judged, (F.col("host") == F.col("__host")) & (F.col("__segments") == F.col("__key")), "left")
    verdict = F.coalesce(label, F.when((F.col("__evidence") > 0) & (F.col("purity") >= settings.block_from), "block").otherwise("allow"))
    return rows.select(*rest, "host", "path", F.col("__rule.prefix").alias("rule"), verdict.alias("verdict"), "template", "purity")
