import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.fixture import MODEM, RADIO, SCHEMAS, entries, store
from tidemark.model import ERROR, as_entries
from tidemark.operators import ingest, limits, seeds, spans, storage, timeline
from tidemark.operators.reader import Reader
from tidemark.plans.query import Query
from tidemark.schema import Range, Schema, SchemaError, dimensions
from tidemark.sources import parquet_store
from tidemark.streaming import live

from tests.oracle import DATA


def test_ingest_writes_what_is_declared_and_reads_back(spark, tmp_path):
    root, dims = str(tmp_path / "s"), dimensions(spark, SCHEMAS)
    store_id = parquet_store.create(spark, root)
    assert parquet_store.create(spark, root) == store_id
    for i in range(4):
        parquet_store.add_namespace(spark, root, f"orc-radio-{i}", RADIO)
    for i in range(3):
        parquet_store.add_namespace(spark, root, f"apt-modem-{i}", MODEM)
    rows = entries(spark, DATA)
    rejected = ingest.ingest(rows, dims, f"{root}/entries")
    assert {r.violation for r in rejected.select("violation").distinct().collect()} == {"unknown_event"}
    s = parquet_store.open_store(spark, root)
    assert {r.protocol_version for r in s.entries.select("protocol_version").distinct().collect()} == {1}
    assert s.entries.count() + rejected.count() == rows.count() and s.store_id == store_id and s.runs.count() == 0
    direct = Reader(store(spark, DATA), SCHEMAS).matched(Query().event_ids(1, 2, 3, 4))
    keys = ["namespace", "channel", "boot", "at_us", "seq", "name", "severity"]
    assert sorted(map(tuple, Reader(s, SCHEMAS).matched(Query()).select(keys).collect()), key=repr) == sorted(map(tuple, direct.select(keys).collect()), key=repr)


def test_namespaces_keep_their_schema(spark, tmp_path):
    root = str(tmp_path / "s")
    parquet_store.create(spark, root)
    parquet_store.add_namespace(spark, root, "a", Schema("x", 2))
    for name, schema in (("a", Schema("y")), ("a", Schema("x", 1)), ("a", Schema("x", 3)), (".a", Schema("x", 2)), ("a/b", Schema("x", 2))):
        with pytest.raises(parquet_store.StoreError):
            parquet_store.add_namespace(spark, root, name, schema)
    assert parquet_store.open_store(spark, root).namespaces.count() == 1


def test_wrong_types_are_rejected_but_state_codes_pass(spark):
    rows = as_entries(spark.createDataFrame([("n", 1, "sample", 1, "f64"), ("n", 2, "sample", 1, "u64"), ("n", 3, "sample", 2, "u64"), ("n", 4, "sample", 9, "f64")], "namespace string, seq bigint, kind string, metric int, vtype string"))
    judged = ingest.violations(rows.withColumn("schema_name", F.lit("radio")), dimensions(spark, SCHEMAS))
    assert {r.seq: r.violation for r in judged.collect()} == {1: None, 2: "wrong_type", 3: None, 4: "unknown_metric"}


def test_text_goes_by_level(spark):
    rows = spark.createDataFrame([("radio", "text", ERROR), ("radio", "text", 3)], "schema_name string, kind string, text_level int").withColumns({c: F.lit(None).cast("int") for c in ("event", "metric", "span_kind")})
    assert [r.channel for r in ingest.routed(rows, dimensions(spark, SCHEMAS)).orderBy("text_level").collect()] == ["default", "critical"]


def test_policies():
    assert ingest.ChannelPolicy.of(1 << 30).segment_size == 4 << 20 and ingest.ChannelPolicy.of(1 << 40).segment_size == 256 << 20
    assert ingest.ChannelPolicy.critical(1 << 30).immediate and ingest.ChannelPolicy.of(1 << 30).max_segments == 256
    with pytest.raises(ValueError):
        ingest.ChannelPolicy.of(1 << 20)


def test_rotation_spares_the_newest(spark):
    segs = spark.createDataFrame([("n", "c", 0, b, 100) for b in range(5)], "namespace string, channel string, boot bigint, base_us bigint, size bigint")
    gone = lambda budget: sorted(r.base_us for r in storage.over_budget(segs, F.lit(budget)).collect())
    assert gone(500) == [] and gone(250) == [0, 1, 2] and gone(1) == [0, 1, 2, 3]


def test_anchor_priorities(spark):
    ok = 1_700_000_000_000
    rows = [(0, i, s, ok + i) for i, s in enumerate([1, 3, 1, 2, 3])] + [(1, 0, 3, 5)]
    syncs = spark.createDataFrame(rows, "hw_boot bigint, arrival bigint, source int, utc_ms bigint")
    accepted = [bool(r.accepted) for r in timeline.accepted_syncs(syncs).where("hw_boot = 0").orderBy("arrival").collect()]
    assert accepted == [True, True, False, False, True]
    assert [tuple(r) for r in timeline.final_anchors(syncs).collect()] == [(0, ok + 4, 3)]


def test_registration_and_retention(spark):
    none = spark.createDataFrame([], parquet_store.RUNS), spark.createDataFrame([], "hw_boot bigint, kernel_boot_id binary")
    runs, hw = timeline.registered(*none, b"a" * 16, 5)
    runs, hw = timeline.registered(runs, hw, b"a" * 16, 6)
    runs, hw = timeline.registered(runs, hw, b"b" * 16, 7)
    assert sorted(map(tuple, runs.collect())) == [(0, 0, 5), (1, 0, 6), (2, 1, 7)] and hw.count() == 2
    kept, kept_hw = timeline.retained(runs, hw, spark.createDataFrame([(1,)], "boot bigint"), current=1)
    assert [r.boot for r in kept.collect()] == [1] and [r.hw_boot for r in kept_hw.collect()] == [0]


def test_limits_are_checked_and_cleared(spark):
    over = limits.Limits({"n": RADIO})
    for broken in (
        lambda: over.set_ranges("n", 2, Range(0, 1)), lambda: over.set_states("n", 1, {0: "warn"}), lambda: over.set_states("n", 2, {9: "warn"}), lambda: over.set_ranges("x", 1),
        lambda: over.set_ranges("n", 9), lambda: over.set_ranges("n", 1, Range(0, 10), Range(0, 5)),
    ):
        with pytest.raises(SchemaError):
            broken()
    over.set_ranges("n", 1, Range(None, 1), Range(None, 2))
    over.clear("n", 1)
    assert over.tables(spark)[0].count() == 0


def test_stream_clamps_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    one = spark.createDataFrame([("n", "c", 0, 100, 1), ("n", "c", 0, 50, 2), ("n", "c", 1, 5, 3)], "namespace string, channel string, boot bigint, at_us bigint, seq bigint")
    two = spark.createDataFrame([("n", "c", 0, 70, 4), ("n", "c", 0, 200, 5)], one.schema)
    for part in (one, two):
        as_entries(part).coalesce(1).write.mode("append").parquet(source)
        stream = live.monotone(live.live(spark, source).select(*one.columns))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted((r.seq, r.at_us) for r in spark.read.parquet(out).collect()) == [(1, 100), (2, 100), (3, 5), (4, 100), (5, 200)]


def test_stream_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("n", "text", 10.0), ("n", "text", 20.0), ("n", "ext", 4000.0)], "namespace string, kind string, t double").select("namespace", "kind", F.col("t").cast("timestamp").alias("utc")).write.parquet(source)
    rows = spark.readStream.schema("namespace string, kind string, utc timestamp").parquet(source)
    query = live.counts(rows).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r.kind, r.n) for r in spark.table("counted").collect()) == [("ext", 1), ("text", 2)]


def test_paths_of_deep_chains_and_cycles(spark):
    rows = [(0, k, k - 1 if k > 1 else None) for k in range(1, 101)] + [(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, None), (1, 5, 9)]
    got = {(r.boot, r.span): (r.root, r.depth) for r in spans.paths(spark.createDataFrame(rows, "boot int, span int, parent int")).collect()}
    assert len(got) == len(rows) and all(got[0, k] == (1, k - 1) for k in range(1, 101))
    assert got[1, 1] == got[1, 2] == got[1, 3] == (None, None) and got[1, 4] == (4, 0) and got[1, 5] == (9, 1)
    assert spans.paths(spark.createDataFrame([], "boot int, span int, parent int")).count() == 0


def test_segments_that_may_hold_a_window(spark):
    """The cases of the reference's cursor.rs, and a gap."""
    table = lambda *bases: spark.createDataFrame([("n", "c", b, x) for b, x in bases], "namespace string, channel string, boot int, base_us bigint")
    pick = lambda t, a, b: sorted((r.boot, r.base_us) for r in storage.in_window(t, a, b).collect())
    three = table((0, 0), (0, 100), (0, 200))
    bases = lambda a, b: [x for _, x in pick(three, a, b)]
    assert bases(100, None) == [0, 100, 200] and bases(101, None) == [100, 200] and bases(250, None) == [200] and bases(9999, None) == [200]
    assert bases(None, 100) == [0, 100] and bases(None, 99) == [0] and bases(None, 0) == [0]
    assert pick(table((0, 500), (1, 10), (1, 900)), 400, None) == [(0, 500), (1, 10), (1, 900)]
    assert pick(table((0, 0), (0, 900)), 500, 600) == [(0, 0)] and pick(table((0, 100)), 2**62, None) == [(0, 100)]


def test_monotone_over_stretches(spark):
    import random

    r = random.Random(4)
    rows = [("n", "c", b, r.randrange(1000), s) for b in (0, 1) for s in r.sample(range(200), 90)]
    records = spark.createDataFrame(rows, "namespace string, channel string, boot bigint, at_us bigint, seq bigint")
    want, top = set(), {}
    for _, _, b, t, s in sorted(rows, key=lambda x: x[4]):
        top[b] = max(t, top.get(b, 0))
        want.add((b, s, top[b]))
    for n in (7, 1 << 20):
        out = ingest.monotone(records, arrivals=n)
        assert out.columns == records.columns and {(x.boot, x.seq, x.at_us) for x in out.collect()} == want


def test_spans_are_written_with_their_parents(spark):
    works = [("a", "x", None, 1, 10, 90), ("b", "y", "x", 1, 20, None), ("a", "z", "y", 7, 30, 25), ("a", "q", "gone", 1, 5, 6)]
    rows = spark.createDataFrame([(0, n, "radio", w, up, k, s, e, i) for i, (n, w, up, k, s, e) in enumerate(works)], "boot bigint, namespace string, schema_name string, work string, within string, span_kind int, start_us bigint, end_us bigint, seq bigint")
    records = spans.recorded(rows)
    table = {r.start_us: r for r in spans.spans(records).collect()}
    assert len({r.span for r in table.values()}) == 4 and min(r.span for r in table.values()) == 1
    assert table[10].parent is None and table[20].parent == table[10].span and table[30].parent == table[20].span and table[5].parent is None
    assert table[20].end_us is None and table[30].end_us == 30 and table[10].took_us == 80
    assert [(r.namespace, r.violation, r.n) for r in ingest.unknown_spans(records, dimensions(spark, SCHEMAS)).collect()] == [("a", "unknown_span_kind", 1)]


def test_identities(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    assert parquet_store.read_store_id(spark, root) is None
    one = parquet_store.create(spark, root)
    # A second creator that looked before the first one wrote.
    parquet_store._write_identity(spark, f"{root}/late", 5)
    assert not parquet_store._moved(spark, f"{root}/late", f"{root}/identity") and parquet_store.create(spark, root) == one == parquet_store.read_store_id(spark, root)
    monkeypatch.setattr(parquet_store, "CONTAINER_VERSION", 2)
    assert parquet_store.create(spark, root) == one
    assert spark.read.parquet(f"{root}/identity").first()["container_version"] == 2
    monkeypatch.setattr(parquet_store, "CONTAINER_VERSION", 1)
    with pytest.raises(errors.FromFuture):
        parquet_store.create(spark, root)
    for f in (tmp_path / "s/identity").glob("*.parquet"):
        f.write_bytes(b"no")
    assert parquet_store.read_store_id(spark, root) is None
    with pytest.raises(errors.Damaged):
        parquet_store.create(spark, root)


def test_kinds_of_errors(spark, tmp_path):
    root = str(tmp_path / "s")
    parquet_store.create(spark, root)
    parquet_store.add_namespace(spark, root, "a", Schema("x", 2))
    for name, schema, kind in (("a", Schema("y"), errors.SchemaMismatch), ("a", Schema("x", 1), errors.FromFuture), ("a", Schema("x", 3), errors.MissingMigration), (".a", Schema("x", 2), errors.BadName)):
        with pytest.raises(kind) as e:
            parquet_store.add_namespace(spark, root, name, schema)
        assert isinstance(e.value, errors.StoreError) and e.value.breaks_contract == (kind is not errors.FromFuture) and not e.value.loses_record
    assert errors.VIOLATIONS["wrong_type"] == (True, True) and not errors.VIOLATIONS["unknown_span_kind"][0]


def test_states_and_differences_over_slices_of_time(spark):
    # Three series over two runs, with ties in time and gaps of many slices between samples.
    times = [0, 0, 3, 9, 10, 11, 95, 100, 100, 101]
    rows = [("n", c, m, b, t * (b + 1), i, float(i * i)) for m, c in ((1, "a"), (1, "b"), (2, "a")) for b in (0, 1) for i, t in enumerate(times)]
    samples = spark.createDataFrame(rows, "namespace string, channel string, metric int, boot bigint, at_us bigint, seq bigint, number double")
    series: dict = {}
    for r in sorted(rows, key=lambda r: (r[4], r[1], r[5])):
        series.setdefault((r[2], r[3]), []).append(r)
    until, steps = {}, {}
    for chain in series.values():
        for before, r, after in zip([None, *chain], chain, [*chain[1:], None]):
            until[r] = after and after[4]
            steps[r] = (r[6] - before[6], r[4] - before[4]) if before else (None, None)
    for slice_us in (1, 10, 1000):
        assert {tuple(r)[:-1]: r.until_us for r in seeds.holding(samples, slice_us).collect()} == until
        assert {tuple(r)[:-2]: (r.delta, r.delta_us) for r in seeds.derivative(samples, slice_us).collect()} == steps
    assert seeds.holding(samples.limit(0)).count() == 0


def test_entry_stands_without_the_training_data_package(monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None if name.startswith("corpus_pipeline") else find(name))
    spec = find("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert "flagship" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    assert set(entry.queries()) <= set(__spark_entry__.queries()) and set(entry.oracle_sql()) == set(entry.queries())
