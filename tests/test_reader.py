"""The radio store: two radio namespaces with 22 messages, 10 samples and a span each, and a modem namespace with one message."""

import pytest
from pyspark.sql import functions as F

from tidemark.model import ERROR, INFO, LOGS, SPANS, TELEMETRY, WARN, as_entries
from tidemark.operators import reader as operators_reader
from tidemark.operators.reader import Reader, Store
from tidemark.plans.query import NEWEST, OLDEST, BootTime, Query, Utc
from tidemark.schema import Event, Metric, Range, Schema, Span, State

RADIO = Schema(
    "radio", 1, ("en", "ru"),
    (Event(1, "PowerSet", INFO, tags=("rf",), templates={"en": "power set", "ru": "мощность задана"}), Event(2, "Alarm", ERROR, "critical", ("fault",), {"en": "alarm", "ru": "авария"})),
    (Metric(1, "temp", "f32", unit="°C", tags=("thermal",), warn=Range(None, 25), alarm=Range(None, 28)), Metric(2, "link", "u64", "state", tags=("rf",), states=(State(0, "Los", "alarm"), State(1, "Lock")))),
    (Span(1, "Calibration"),),
)
ANCHOR = 1_700_000_000_000


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for ns, n in (("orc-radio-0", 20), ("orc-radio-1", 20), ("apt-modem-0", 1)):
        at, seq = 1000, 0

        def put(channel, kind, **values):
            nonlocal at, seq
            at, seq = at + 1000, seq + 1
            rows.append({"namespace": ns, "channel": channel, "boot": 0, "at_us": at, "seq": seq, "kind": kind} | values)

        for _ in range(n):
            put("default", "message", event=1)
        if n > 1:
            put("critical", "message", event=2)
            for v in range(20, 30):
                put("default", "sample", metric=1, vtype="f32", v_f32=float(v))
            put("default", "span_start", span=7, span_kind=1)
            put("default", "message", event=1, span=7)
            put("default", "span_end", span=7)
    columns = "namespace string, channel string, boot bigint, at_us bigint, seq bigint, kind string, event int, span bigint, span_kind int, metric int, vtype string, v_f32 float"
    names = [c.split()[0] for c in columns.split(", ")]
    entries = as_entries(spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], columns)).cache()
    meta = spark.createDataFrame([("orc-radio-0", "radio"), ("orc-radio-1", "radio"), ("apt-modem-0", "modem")], "namespace string, schema_name string")
    runs = spark.createDataFrame([(0, 0, 1_000_000)], "boot bigint, hw_boot bigint, init_us bigint")
    return lambda anchor: Store(entries, meta, runs, spark.createDataFrame([(0, anchor)], "hw_boot bigint, anchor_ms bigint"))


@pytest.fixture(scope="module")
def reader(tables):
    return Reader(tables(None), [RADIO])


def count(reader, q):
    return reader.matched(q).count()


def test_counts(reader):
    assert count(reader, Query().kinds("message")) == 2 * 22 + 1
    assert count(reader, Query().kinds(*TELEMETRY)) == 20
    assert count(reader, Query().kinds(*SPANS)) == 4
    assert count(reader, Query().kinds(*LOGS).min_level(ERROR)) == 2 + 1  # the modem's schema is unknown, so its level stays
    assert count(reader, Query().group("orc-").kinds(*LOGS).min_level(WARN)) == 2
    assert count(reader, Query().any_tags("fault").kinds("message")) == 2
    assert count(reader, Query().named("Alarm").kinds("message")) == 2
    assert count(reader, Query().in_spans(7)) == 6


def test_names_units_and_severities(reader):
    rows = reader.matched(Query().namespaces("orc-radio-0").kinds(*TELEMETRY).order(OLDEST)).groupBy("severity").count().collect()
    assert {r.severity: r["count"] for r in rows} == {"normal": 6, "warn": 3, "alarm": 1}
    s = reader.matched(Query().kinds(*TELEMETRY)).first()
    assert (s.metric_name, s.unit, s.tags, s.metric_kind, s.state) == ("temp", "°C", ["thermal"], "gauge", None)


def test_unknown_schema_leaves_ids(reader):
    r = reader.matched(Query().group("apt-")).first()
    assert (r.event, r.name, r.level, r.tags) == (1, None, None, [])
    assert reader.schema_of("apt-modem-0") is None and reader.schema_of("orc-radio-0").name == "radio"


def test_both_orders_hold_the_same_and_ties_keep_channels(reader):
    old, new = (reader.query(Query().order(o)).entries.select("namespace", "seq").collect() for o in (OLDEST, NEWEST))
    assert sorted(old) == sorted(new) and old != new
    assert [r.namespace for r in old[:3]] == ["apt-modem-0", "orc-radio-0", "orc-radio-1"]


def test_limit_and_truncation(reader):
    assert reader.query(Query().limit(69)).truncated and not reader.query(Query().limit(70)).truncated
    assert reader.query(Query().limit(0)).truncated and reader.query(Query()).complete


def test_stream_is_query(reader):
    q = Query().order(OLDEST).limit(30)
    assert [r.seq for r in reader.stream(q)] == [r.seq for r in reader.query(q).entries.collect()]


@pytest.mark.parametrize("q", [Query().order(OLDEST), Query().order(NEWEST), Query().order(NEWEST).limit(60), Query().group("none-")])
def test_stream_sends_bounded_partitions(reader, monkeypatch, q):
    sent = []
    monkeypatch.setattr(operators_reader, "STREAMED", 7, raising=False)
    monkeypatch.setattr(type(reader.store.entries), "toLocalIterator", lambda df, prefetchPartitions=False: sent.extend(df.rdd.glom().collect()) or (r for part in sent for r in part))
    got = [(r.namespace, r.channel, r.seq) for r in reader.stream(q)]
    assert got == [(r.namespace, r.channel, r.seq) for r in reader.query(q).entries.collect()]
    assert sum(map(len, sent)) == len(got) and max(map(len, sent), default=0) <= 14


def test_wall_window_is_relative_window(tables):
    r = Reader(tables(ANCHOR), [RADIO])
    base = ANCHOR * 1000 + 1_000_000
    rel = Query().range(BootTime(0, 5000), BootTime(0, 20_000))
    assert count(r, rel) == count(r, Query().range(Utc(base + 5000), Utc(base + 20_000))) > 0
    # Halves overlap only at the edge.
    edge = count(r, Query().range(BootTime(0, 9000), BootTime(0, 9000)))
    assert count(r, Query().until(BootTime(0, 9000))) + count(r, Query().since(BootTime(0, 9000))) == count(r, Query()) + edge


def test_unanchored_runs_are_named(reader):
    result = reader.query(Query().since(Utc(0)))
    assert result.entries.count() == 0 and [x.boot for x in result.unanchored.collect()] == [0]
    assert reader.query(Query()).unanchored.count() == 0
    assert reader.query(Query().since(Utc(0)).boot(5)).unanchored.count() == 0


def test_seeds(spark, tables):
    store = tables(None)
    rows = [("orc-radio-0", "default", 0, t, s, "sample", 2, "u64", c) for s, (t, c) in enumerate([(10, 0), (20, 1), (30, 0)])]
    store.entries = as_entries(spark.createDataFrame(rows, "namespace string, channel string, boot bigint, at_us bigint, seq bigint, kind string, metric int, vtype string, v_u64 bigint"))
    r = Reader(store, [RADIO])
    seeds = lambda q: [(x.at_us, x.state) for x in r.query(q).seeds.collect()]
    assert seeds(Query().since(BootTime(0, 25)).with_state_seed()) == [(20, "Lock")]
    assert seeds(Query().since(BootTime(0, 20)).with_state_seed()) == [(10, "Los")]
    assert seeds(Query().since(BootTime(1, 0)).with_state_seed()) == [(30, "Los")]
    assert seeds(Query().since(BootTime(0, 0)).with_state_seed()) == []
    assert seeds(Query().with_state_seed()) == [] and seeds(Query().since(BootTime(0, 25))) == []
    assert seeds(Query().since(BootTime(0, 25)).with_state_seed().in_spans(7)) == []


def test_a_filter_reaches_the_scan(spark, tables, tmp_path):
    from tidemark.operators.ingest import append

    append(tables(None).entries, str(tmp_path / "e"))
    store = tables(None)
    store.entries = spark.read.parquet(str(tmp_path / "e"))
    df = Reader(store, [RADIO]).matched(Query().namespaces("orc-radio-0").kinds("message").min_level(ERROR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan and "event" in plan.split("PushedFilters")[1][:400]
    assert df.count() == 1
    assert store.entries.select(F.max("seq")).first()[0] == 34
