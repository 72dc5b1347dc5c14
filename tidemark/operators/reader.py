"""The reader: runs a Query over a store and reports how complete the answer is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.errors import StoreError
from tidemark.model import TELEMETRY
from tidemark.operators import enrich, timeline
from tidemark.operators.seeds import last_states
from tidemark.plans import query as plan
from tidemark.plans.query import NEWEST, Query
from tidemark.schema import Schema, dimensions

DAMAGE = "path string, offset bigint, reason string"
STREAMED = 50_000  # records that a stream's partition has


@dataclass
class Store:
    """Tables of one store. segments and damage may be missing."""

    entries: DataFrame
    namespaces: DataFrame  # namespace, schema_name
    runs: DataFrame  # boot, hw_boot, init_us
    hw_boots: DataFrame  # hw_boot, anchor_ms
    segments: DataFrame | None = None
    damage: DataFrame | None = None
    store_id: int | None = None


@dataclass
class Result:
    entries: DataFrame
    seeds: DataFrame
    damaged: DataFrame
    unanchored: DataFrame
    most: int | None
    _found: DataFrame

    @cached_property
    def truncated(self) -> bool:
        """Whether the limit was reached; also if nothing more was there. Counts up to the limit, without order or declared columns."""
        return self.most is not None and self._found.limit(self.most).count() == self.most

    @cached_property
    def complete(self) -> bool:
        """Whether nothing was damaged. Runs without anchor and truncation are reported beside it."""
        return self.damaged.isEmpty()


class Reader:
    def __init__(self, store: Store, schemas: list[Schema], allow_foreign: bool = False) -> None:
        self.store, self.schemas, self.allow_foreign = store, schemas, allow_foreign
        self.spark = store.entries.sparkSession
        self.dims = dimensions(self.spark, schemas)
        self.anchors = timeline.anchors(store.runs, store.hw_boots)

    @cached_property
    def known(self) -> list[str]:
        """Namespaces with a schema at hand, for predicates on them: the catalogue's names, which don't grow with the records."""
        rows = self.store.namespaces.where(F.col("schema_name").isin(*(s.name for s in self.schemas))).select("namespace").collect()
        return sorted(r.namespace for r in rows)

    def schema_of(self, namespace: str) -> Schema | None:
        row = self.store.namespaces.where(F.col("namespace") == namespace).first()
        return next((s for s in self.schemas if row and s.name == row["schema_name"]), None)

    def namespaces(self) -> DataFrame:
        """(namespace, schema_name, channels, bytes) of the store's namespaces, by name; those without segments have no channels."""
        segments = self.store.segments if self.store.segments is not None else self.store.entries.select("namespace", "channel", F.lit(0).alias("size")).distinct()
        sums = segments.groupBy("namespace").agg(F.sort_array(F.collect_set("channel")).alias("channels"), F.sum("size").alias("bytes"))
        out = self.store.namespaces.join(sums, "namespace", "left")
        return out.select("namespace", "schema_name", F.coalesce("channels", F.array().cast("array<string>")).alias("channels"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes")).orderBy("namespace")

    def _own(self, rows: DataFrame) -> DataFrame:
        """Records of this store; those of another one are damage unless they are allowed."""
        if self.allow_foreign or self.store.store_id is None or "store_id" not in rows.columns:
            return rows
        return rows.where(F.col("store_id").isNull() | (F.col("store_id") == F.lit(self.store.store_id).cast("decimal(20,0)")))

    def _migrated(self, rows: DataFrame) -> DataFrame:
        """rows with those of earlier versions taken through their schema's migrations. A record's version is its own, else its namespace's; one that no step starts from stays as it is."""
        moving = [s for s in self.schemas if s.migrations]
        if not moving:
            return rows
        columns = rows.columns
        names = self.store.namespaces
        names = names.select("namespace", F.col("schema_name").alias("__schema"), (F.col("protocol_version") if "protocol_version" in names.columns else F.lit(None).cast("int")).alias("__since"))
        rows = rows.join(names, "namespace", "left")
        version = F.coalesce(F.col("protocol_version"), F.col("__since")) if "protocol_version" in columns else F.col("__since")
        steps = [(s, v, (F.col("__schema") == s.name) & (version == v)) for s in moving for v in range(min(m.from_version for m in s.migrations), s.version)]
        old = reduce(Column.__or__, (test for _, _, test in steps))
        parts = [rows.where(~F.coalesce(old, F.lit(False))).select(columns)]
        return reduce(DataFrame.unionByName, [*parts, *(s.migrate(rows.where(test).select(columns), v).select(columns) for s, v, test in steps)])

    def selected(self, q: Query) -> DataFrame:
        """Stored records that q may return: every predicate here is on stored columns and reaches the scan. A wall-clock window does as bounds by run."""
        rows = self._migrated(self._own(self.store.entries)).where(plan.place(q)).where(plan.relative_window(q)).where(plan.kind_filter(q))
        rows = rows.where(plan.pushed_ids(q, self.schemas, self.known if q.level is not None else None))
        if not q.anchored_only:
            return rows
        bands = timeline.bands(self.anchors if q.run is None else self.anchors.where(F.col("boot") == q.run), q)
        return reduce(DataFrame.unionByName, (rows.where(b) for b in bands)) if bands else rows.where(F.lit(False))

    def _exact(self, q: Query) -> DataFrame:
        """Stored columns of the records that q selects. Only what its filters need is joined."""
        rows = self.selected(q)
        columns = rows.columns
        if q.anchored_only:
            rows = timeline.with_utc(rows, self.anchors).where(plan.wall_window(q))
        if q.level is not None or q.tags or q.event_names:
            rows = rows.select(columns).join(self.store.namespaces.select("namespace", "schema_name"), "namespace", "left")
            rows = enrich.messages(rows, self.dims).withColumnRenamed("event_tags", "tags").where(plan.declared(q))
        return rows.where(plan.later(q)).select(columns)

    def _enriched(self, rows: DataFrame) -> DataFrame:
        return enrich.enriched(timeline.with_utc(rows, self.anchors), self.store.namespaces, self.dims)

    def matched(self, q: Query) -> DataFrame:
        """Enriched records that q selects, in no order."""
        return self._enriched(self.selected(q)).where(plan.wall_window(q) if q.anchored_only else F.lit(True)).where(plan.declared(q)).where(plan.later(q))

    def query(self, q: Query) -> Result:
        keys, found = plan.order_keys(q.direction), self._exact(q)
        if q.most is None:
            entries = self.matched(q).orderBy(*keys)
        else:  # the limit comes before whatever isn't needed to take it
            entries = self._enriched(found.orderBy(*keys).limit(q.most)).orderBy(*keys).limit(q.most)
        return Result(entries, self.seeds(q), self.damage(), self.unanchored(q), q.most, found)

    def stream(self, q: Query) -> Iterator[Row]:
        """The same records one by one, a partition at a time. Partitions are ranges of the order with about STREAMED records each, as the driver holds one and the next."""
        keys, found = plan.order_keys(q.direction), self._exact(q)
        if q.most is not None:
            found = found.orderBy(*keys).limit(q.most)
        ranges = max(1, -(-found.count() // STREAMED))
        return self._enriched(found).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).toLocalIterator(prefetchPartitions=True)

    def unanchored(self, q: Query) -> DataFrame:
        """Runs that a wall-clock window had to leave out, among the selected places."""
        seen = self._own(self.store.entries).where(plan.place(q))
        return timeline.unanchored_boots(seen if q.anchored_only else seen.limit(0), self.anchors)

    def damage(self) -> DataFrame:
        """What could not be read: reported by the source, segments of another store, namespaces without known meta."""
        found = [self.spark.createDataFrame([], DAMAGE)]
        if self.store.damage is not None:
            found.append(self.store.damage.select("path", "offset", "reason"))
        if self.store.segments is not None and self.store.store_id is not None and not self.allow_foreign and "store_id" in self.store.segments.columns:
            foreign = self.store.segments.where(F.col("store_id") != F.lit(self.store.store_id).cast("decimal(20,0)"))
            found.append(foreign.select("path", F.lit(0).cast("bigint").alias("offset"), F.lit("segment of another store").alias("reason")))
        if self.store.segments is not None:
            lost = self.store.segments.select("namespace").distinct().join(self.store.namespaces, "namespace", "left_anti")
            found.append(lost.select(F.col("namespace").alias("path"), F.lit(0).cast("bigint").alias("offset"), F.lit("namespace without meta").alias("reason")))
        return reduce(DataFrame.unionByName, found)

    def seeds(self, q: Query, strict: bool = False, max_segments: int | None = None) -> DataFrame:
        """The last state of each state series before the window; none unless q asks for seeds and has a start. A span filter leaves none, as samples have no span. strict: match metric ids over all schemas together. max_segments: look at that many newest segments of a channel only."""
        states = self.dims.metrics.where("metric_kind = 'state'").select("schema_name", "metric")
        rows = self._migrated(self._own(self.store.entries)).where(plan.place(q)).where(F.col("kind").isin(*TELEMETRY))
        if q.spans:
            rows = rows.where(F.coalesce(F.col("span").isin(*q.spans), F.lit(False)))
        if q.start is None or not q.seeds:
            rows = rows.limit(0)
        else:
            before = Query(end=q.start.just_before())
            rows = rows.where(plan.relative_window(before))
            if before.anchored_only:
                bands = timeline.bands(self.anchors, before)
                rows = timeline.with_utc(reduce(DataFrame.unionByName, (rows.where(b) for b in bands)) if bands else rows.limit(0), self.anchors).where(plan.wall_window(before))
        rows = rows.drop("utc", "utc_us").join(self.store.namespaces.select("namespace", "schema_name"), "namespace", "left")
        on = ["metric"] if strict else ["schema_name", "metric"]
        rows = rows.join(states.select(*on).distinct(), on, "left_semi").drop("schema_name")
        if max_segments is not None and self.store.segments is None:
            raise StoreError("this store has no table of segments")
        if max_segments is not None and q.start is not None:
            held = self.store.segments.where(plan.place(q)).withColumnRenamed("base_us", "at_us").where(plan.relative_window(Query(end=q.start))).withColumnRenamed("at_us", "base_us")
            first = newest_segments(held, max_segments).groupBy("namespace", "channel").agg(F.min(F.struct("boot", "base_us")).alias("__first"))
            rows = rows.join(first, ["namespace", "channel"]).where(F.struct("boot", F.col("at_us").alias("base_us")) >= F.col("__first")).drop("__first")
        found = enrich.enriched(timeline.with_utc(last_states(rows), self.anchors), self.store.namespaces, self.dims)
        return found.orderBy("boot", "at_us", "namespace", "channel", "metric")


def newest_segments(segments: DataFrame, k: int) -> DataFrame:
    """The k newest segments of each channel."""
    newest = Window.partitionBy("namespace", "channel").orderBy(F.desc("boot"), F.desc("base_us"))
    return segments.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= k).drop("age")


__all__ = ["NEWEST", "Reader", "Result", "Store", "newest_segments"]
