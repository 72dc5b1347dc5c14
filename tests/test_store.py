"""A store on disk: opened whole, pruned by time, migrated on reading, and damaged."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidemark.fixture import EPOCH_US, RUN_US, SCHEMAS, entries, runs, store
from tidemark.model import ERROR, WARN, as_entries
from tidemark.operators import ingest, timeline
from tidemark.operators.reader import Reader, Store
from tidemark.plans.query import NEWEST, OLDEST, BootTime, Query, Utc
from tidemark.schema import Event, Migration, Schema, dimensions
from tidemark.sources import parquet_store

KEYS = ["namespace", "channel", "boot", "at_us", "seq", "name", "severity"]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "s")
    parquet_store.create(spark, root)
    for r in store(spark, DATA).namespaces.collect():
        parquet_store.add_namespace(spark, root, r.namespace, next(s for s in SCHEMAS if s.name == r.schema_name))
    ingest.ingest(entries(spark, DATA), dimensions(spark, SCHEMAS), f"{root}/entries")
    parquet_store.save_runs(*runs(spark), root, "0")
    return root


@pytest.fixture()
def reader(spark, root):
    return Reader(parquet_store.open_store(spark, root), SCHEMAS)


def rows(df, columns=KEYS):
    return sorted(map(tuple, df.select(columns).collect()), key=repr)


def scans(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    text = df._jdf.queryExecution().executedPlan().toString()
    return [(line.partition("PartitionFilters: [")[2].partition("], PushedFilters")[0], line.partition("PushedFilters: [")[2].partition("], ReadSchema")[0]) for line in text.splitlines() if "FileScan parquet" in line and "at_us" in line]


def test_an_opened_store_lists_itself(spark, root, reader):
    direct = Reader(store(spark, DATA), SCHEMAS)
    listed = reader.namespaces().collect()
    assert [(r.namespace, r.schema_name, r.channels) for r in listed] == [(r.namespace, r.schema_name, r.channels) for r in direct.namespaces().collect()]
    assert all(r.bytes > 0 for r in listed) and reader.damage().count() == 0 and reader.query(Query()).complete
    segments = reader.store.segments.collect()
    assert sum(r.n_records for r in segments) == reader.store.entries.count() and all(r.base_us == r.min_us <= r.max_us for r in segments)
    q = Query().since(BootTime(3, 86_400_000_000)).with_state_seed()
    columns = ["namespace", "channel", "metric", "boot", "at_us", "state"]
    assert rows(reader.seeds(q), columns) == rows(direct.seeds(q), columns) == rows(reader.seeds(q, max_segments=1000), columns)
    assert Reader(Store(reader.store.entries, reader.store.namespaces, *runs(spark)), SCHEMAS).namespaces().count() == 7


@pytest.mark.parametrize("q", [
    Query().range(Utc(EPOCH_US + RUN_US // 3), Utc(EPOCH_US + RUN_US + RUN_US // 2)),
    Query().since(Utc(EPOCH_US + 4 * RUN_US + RUN_US // 2)),
    Query().until(Utc(EPOCH_US + RUN_US // 4)),
    Query().range(BootTime(1, RUN_US // 2), Utc(EPOCH_US + 4 * RUN_US + 5)),
    Query().since(Utc(EPOCH_US)).boot(1),
    Query().range(Utc(0), Utc(5)),
])
def test_wall_windows_prune(spark, reader, q):
    direct = Reader(store(spark, DATA), SCHEMAS)
    want = timeline.with_utc(direct.store.entries.where("event is null or event <> 99"), direct.anchors)
    low, high = (x.us if isinstance(x, Utc) else None for x in (q.start, q.end))
    want = want.where(F.col("utc_us") >= (low if low is not None else -(2**62))).where(F.col("utc_us") <= (high if high is not None else 2**62))
    if isinstance(q.start, BootTime):
        want = want.where((F.col("boot") > q.start.boot) | ((F.col("boot") == q.start.boot) & (F.col("at_us") >= q.start.at_us)))
    if q.run is not None:
        want = want.where(F.col("boot") == q.run)
    assert rows(reader.matched(q), ["seq", "utc_us"]) == rows(want, ["seq", "utc_us"])


def test_filters_of_windows_reach_the_scan(reader):
    only_last = scans(reader.matched(Query().since(Utc(EPOCH_US + 5 * RUN_US + RUN_US // 2))))
    assert len(only_last) == 1 and "boot" in only_last[0][0] and "GreaterThanOrEqual(at_us" in only_last[0][1]
    # From the middle of run 0 to the middle of run 1: each has its own bounds.
    found = scans(reader.matched(Query().range(Utc(EPOCH_US + RUN_US // 2), Utc(EPOCH_US + RUN_US + RUN_US // 2))))
    assert len(found) == 2 and all("boot" in p for p, _ in found) and any("GreaterThanOrEqual(at_us" in f for _, f in found) and all("LessThanOrEqual(at_us" in f for _, f in found)
    mixed = scans(reader.matched(Query().range(BootTime(0, 5), Utc(EPOCH_US + RUN_US))))
    assert mixed and all("boot" in p and "at_us" in f for p, f in mixed)
    flagship = Query().group("orc-").min_level(WARN).since(Utc(EPOCH_US + 5 * RUN_US + 7)).order(OLDEST).limit(500)
    assert all("boot" in p and "namespace" in p and "GreaterThanOrEqual(at_us" in f for p, f in scans(reader.query(flagship).entries))


def test_bands_stay_few_and_lose_nothing(spark):
    many = spark.range(5000).selectExpr("id as boot", "id * 1000 as init_us", "cast(if(id % 7 = 3, null, 0) as bigint) as anchor_ms")
    for q in (Query().since(Utc(2_500_300)), Query().until(Utc(2_500_300)), Query().range(Utc(1_000_100), Utc(1_001_900))):
        bands = timeline.bands(many, q)
        assert 0 < sum(str(b).count("boot") for b in bands) <= 3 * 64
        fit = timeline.run_bounds(many, q).where("fit = 'in'").selectExpr("boot", "explode(array(coalesce(low_us, 0), coalesce(high_us, 1000000000000))) as at_us")
        kept = [fit.where(b) for b in bands]
        assert sum(k.count() for k in kept) == fit.count()
    assert timeline.bands(many, Query().until(Utc(-1))) == []


def test_a_limit_comes_before_the_joins(reader):
    for q in (Query().limit(20).order(NEWEST), Query().since(Utc(EPOCH_US + RUN_US)).limit(20), Query().min_level(ERROR).limit(20)):
        want = reader.matched(q).orderBy(F.desc("boot"), F.desc("at_us"), "namespace", "channel", F.desc("seq")).limit(20)
        result = reader.query(q)
        assert [tuple(r) for r in result.entries.select(KEYS).collect()] == [tuple(r) for r in want.select(KEYS).collect()]
        assert result.truncated
        plan = result.entries._jdf.queryExecution().optimizedPlan().toString()
        top, _, below = plan.rpartition("GlobalLimit")
        assert "metric_name" not in below.partition("LocalRelation")[0] and top.count("Join") >= 4


def test_many_namespaces_keep_pushed_levels(spark, tmp_path):
    names = spark.range(2000).selectExpr("concat('n', id) as namespace", "if(id % 2 = 0, 'radio', 'gone') as schema_name")
    ingest.append(spark.range(4000).selectExpr("concat('n', id % 2000) as namespace", "'c' as channel", "id div 1000 as boot", "id as at_us", "id as seq", "'message' as kind", "cast(1 + id % 4 as int) as event").where("seq % 50 < 2 and boot = 0"), str(tmp_path / "e"))
    r = Reader(Store(spark.read.parquet(str(tmp_path / "e")), names, *runs(spark)), SCHEMAS)
    assert len(r.known) == 1000
    df = r.matched(Query().min_level(ERROR))
    assert "event" in scans(df)[0][1] or "event" in df._jdf.queryExecution().executedPlan().toString().partition("DataFilters")[2][:3000]
    assert sorted(x.seq for x in df.collect()) == [s for s in range(1000) if s % 50 < 2 and (s % 2 or s % 4 == 3)]


def test_damaged_files_are_named_and_the_rest_is_read(spark, tmp_path):
    root = str(tmp_path / "s")
    parquet_store.create(spark, root)
    parquet_store.add_namespace(spark, root, "orc-radio-0", SCHEMAS[0])
    records = as_entries(spark.createDataFrame([("orc-radio-0", "default", b, b, b, "message", 1) for b in range(3)], "namespace string, channel string, boot bigint, at_us bigint, seq bigint, kind string, event int"))
    ingest.append(records, f"{root}/entries")
    parquet_store.save_runs(*runs(spark), root, "0")
    broken = next((tmp_path / "s/entries").glob("*/*/boot=1/*.parquet"))
    broken.write_bytes(broken.read_bytes()[:-20])
    for table in ("runs/0", "hw_boots/0"):
        for f in (tmp_path / "s" / table).glob("*.parquet"):
            f.write_bytes(b"PAR1 nothing")
    reader = Reader(parquet_store.open_store(spark, root), SCHEMAS)
    result = reader.query(Query())
    assert sorted(r.seq for r in result.entries.collect()) == [0, 2] and not result.complete
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in result.damaged.collect()] == [(broken.name, "the file can't be read")]
    assert reader.store.runs.count() == 0 and [r.boot for r in reader.query(Query().since(Utc(0))).unanchored.collect()] == [0, 2]
    assert [r.namespace for r in reader.namespaces().collect()] == ["orc-radio-0"]
    assert parquet_store.open_store(spark, str(tmp_path / "none")).entries.count() == 0


def test_records_of_earlier_versions_are_migrated(spark):
    steps = (Migration(1, lambda d: d.withColumn("event", F.lit(2)), events=(1,)), Migration(2, lambda d: d.limit(0), events=(3,)))
    schema = Schema("radio", 3, events=(Event(2, "New", WARN),), migrations=steps)
    columns = "namespace string, channel string, boot bigint, at_us bigint, seq bigint, kind string, event int, protocol_version int"
    records = as_entries(spark.createDataFrame([(n, "c", 0, i, i, "message", e, v) for i, (n, e, v) in enumerate([("a", 1, 1), ("a", 3, 1), ("a", 1, 2), ("a", 3, 2), ("a", 1, 3), ("a", 3, 3), ("a", 1, None), ("b", 1, 1), ("c", 1, None)])], columns))
    names = spark.createDataFrame([("a", "radio", 3), ("b", "other", 1), ("c", "radio", 1)], "namespace string, schema_name string, protocol_version int")
    reader = Reader(Store(records, names, *runs(spark)), [schema])
    assert sorted((r.seq, r.event) for r in reader.matched(Query()).collect()) == [(0, 2), (2, 1), (4, 1), (5, 3), (6, 1), (7, 1), (8, 2)]
    assert sorted(r.seq for r in reader.matched(Query().named("New")).collect()) == [0, 8]
