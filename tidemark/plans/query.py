"""The query builder: what to select, as a value; and its compilation to Spark predicates.

Filters on declared properties (level, tags, names) are also resolved to event ids from the schemas at hand, so that a plain
id predicate reaches the Parquet scan; the exact rule is applied after the dimension join.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import KINDS
from tidemark.schema import Schema

OLDEST, NEWEST = "oldest", "newest"


@dataclass(frozen=True)
class BootTime:
    """Time within a run."""

    boot: int
    at_us: int

    def just_before(self) -> BootTime:
        return BootTime(self.boot, max(0, self.at_us - 1))


@dataclass(frozen=True)
class Utc:
    """Anchored time, in microseconds since 1970."""

    us: int

    @classmethod
    def of(cls, at: datetime) -> Utc:
        return cls(round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000))

    def just_before(self) -> Utc:
        return Utc(self.us - 1)


Time = BootTime | Utc


@dataclass(frozen=True)
class Query:
    prefix: str | None = None
    names: tuple[str, ...] | None = None
    channels: tuple[str, ...] = ()
    run: int | None = None
    start: Time | None = None
    end: Time | None = None
    level: int | None = None
    tags: tuple[str, ...] = ()
    events: tuple[int, ...] = ()
    event_names: tuple[str, ...] = ()
    spans: tuple[int, ...] = ()
    metrics: tuple[int, ...] = ()
    kind_set: tuple[str, ...] = KINDS
    direction: str = NEWEST
    most: int | None = None
    seeds: bool = False
    after: tuple | None = field(default=None)

    def group(self, prefix: str) -> Query:
        """Namespaces whose name starts with prefix."""
        return replace(self, prefix=prefix, names=None)

    def namespaces(self, *names: str) -> Query:
        return replace(self, names=names, prefix=None)

    def channel(self, *names: str) -> Query:
        return replace(self, channels=(*self.channels, *names))

    def boot(self, boot: int) -> Query:
        return replace(self, run=boot)

    def since(self, at: Time) -> Query:
        return replace(self, start=at)

    def until(self, at: Time) -> Query:
        return replace(self, end=at)

    def range(self, start: Time, end: Time) -> Query:
        return replace(self, start=start, end=end)

    def boot_window(self, boot: int, from_us: int, to_us: int) -> Query:
        return self.boot(boot).range(BootTime(boot, from_us), BootTime(boot, to_us))

    def min_level(self, level: int) -> Query:
        return replace(self, level=level)

    def any_tags(self, *tags: str) -> Query:
        return replace(self, tags=tags)

    def event_ids(self, *ids: int) -> Query:
        return replace(self, events=ids)

    def named(self, *names: str) -> Query:
        return replace(self, event_names=names)

    def in_spans(self, *spans: int) -> Query:
        return replace(self, spans=spans)

    def of_metrics(self, *ids: int) -> Query:
        """Samples of these metrics (other kinds are not touched)."""
        return replace(self, metrics=ids)

    def kinds(self, *kinds: str) -> Query:
        return replace(self, kind_set=kinds)

    def order(self, direction: str) -> Query:
        return replace(self, direction=direction)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def with_state_seed(self) -> Query:
        return replace(self, seeds=True)

    def page_after(self, boot: int, at_us: int, namespace: str, channel: str, seq: int) -> Query:
        """Only what comes after this record in the query's order: the next page."""
        return replace(self, after=(boot, at_us, namespace, channel, seq))

    @property
    def anchored_only(self) -> bool:
        return isinstance(self.start, Utc) or isinstance(self.end, Utc)


def place(q: Query) -> Column:
    """Namespaces, channels and runs: partition columns, so these prune files."""
    out = F.lit(True)
    if q.prefix is not None:
        out = out & F.col("namespace").startswith(q.prefix)
    if q.names is not None:
        out = out & F.col("namespace").isin(*q.names)
    if q.channels:
        out = out & F.col("channel").isin(*q.channels)
    if q.run is not None:
        out = out & (F.col("boot") == q.run)
    return out


def relative_window(q: Query) -> Column:
    """Run-relative bounds, inclusive, in order of (boot, at_us)."""
    out = F.lit(True)
    boot, at = F.col("boot"), F.col("at_us")
    if isinstance(q.start, BootTime):
        out = out & ((boot > q.start.boot) | ((boot == q.start.boot) & (at >= q.start.at_us)))
    if isinstance(q.end, BootTime):
        out = out & ((boot < q.end.boot) | ((boot == q.end.boot) & (at <= q.end.at_us)))
    return out


def wall_window(q: Query) -> Column:
    """Anchored bounds over utc_us; runs without anchor have none and go."""
    out = F.lit(True)
    if isinstance(q.start, Utc):
        out = out & (F.col("utc_us") >= q.start.us)
    if isinstance(q.end, Utc):
        out = out & (F.col("utc_us") <= q.end.us)
    return F.coalesce(out, F.lit(False))


def kind_filter(q: Query) -> Column:
    """Kinds; extension records always pass, and the span filter is the only one that drops them."""
    kind = F.col("kind")
    out = kind.isin(*q.kind_set) | (kind == "ext") if {*q.kind_set} != {*KINDS} else F.lit(True)
    if q.spans:
        out = out & F.coalesce(F.col("span").isin(*q.spans), F.lit(False))
    if q.metrics:
        out = out & ((kind != "sample") | F.col("metric").isin(*q.metrics))
    return out


def pushed_ids(q: Query, schemas: list[Schema], known: list[str] | None = None) -> Column:
    """A predicate on stored columns that keeps whatever declared() may keep. Ids stand for the schemas' properties. known: the namespaces whose schema is at hand; levels are unknown, and so pass, in all others (None: nothing is known of them)."""
    out = F.lit(True)
    message = F.col("kind") == "message"
    if q.events:
        out = out & (~message | F.col("event").isin(*q.events))
    declared = {e.id for s in schemas for e in s.events}
    if q.level is not None and known is None:
        out = out & ((F.col("kind") != "text") | (F.col("text_level") >= q.level))
    elif q.level is not None:
        ids = {e.id for s in schemas for e in s.events if e.level >= q.level}
        # What some schema doesn't declare may be unknown there, and unknown levels stay.
        ids |= {i for i in declared for s in schemas if s.event(i) is None}
        out = out & (~message | F.col("event").isin(*sorted(ids)) | ~F.col("event").isin(*sorted(declared)) | ~F.col("namespace").isin(*known))
        out = out & ((F.col("kind") != "text") | (F.col("text_level") >= q.level))
    if q.tags:
        out = out & (~message | F.col("event").isin(*sorted({e.id for s in schemas for e in s.events if {*e.tags} & {*q.tags}})))
    if q.event_names and "" not in q.event_names:
        out = out & (~message | F.col("event").isin(*sorted({e.id for s in schemas for e in s.events if e.name in q.event_names})))
    return out


def declared(q: Query) -> Column:
    """Level, tags and names, over the columns of the dimension join. Unknown levels pass; unknown tags and names don't."""
    out = F.lit(True)
    message = F.col("kind") == "message"
    if q.level is not None:
        out = out & (~message | (F.coalesce(F.col("level"), F.lit(99)) >= q.level))
    if q.tags:
        out = out & (~message | F.arrays_overlap(F.coalesce(F.col("tags"), F.array().cast("array<string>")), F.array(*(F.lit(t) for t in q.tags))))
    if q.event_names:
        out = out & (~message | F.coalesce(F.col("name"), F.lit("")).isin(*q.event_names))
    return out


def order_keys(direction: str) -> list[Column]:
    """Ties go to the first namespace and channel in both directions; within a channel the newest order reverses."""
    if direction == OLDEST:
        return [F.col(c).asc() for c in ("boot", "at_us", "namespace", "channel", "seq")]
    return [F.col("boot").desc(), F.col("at_us").desc(), F.col("namespace").asc(), F.col("channel").asc(), F.col("seq").desc()]


def later(q: Query) -> Column:
    """Rows after the page token in the query's order."""
    if q.after is None:
        return F.lit(True)
    down = q.direction == NEWEST
    out, equal = F.lit(False), F.lit(True)
    for name, value, back in zip(("boot", "at_us", "namespace", "channel", "seq"), q.after, (down, down, False, False, down), strict=True):
        out = out | (equal & ((F.col(name) < value) if back else (F.col(name) > value)))
        equal = equal & (F.col(name) == value)
    return out
