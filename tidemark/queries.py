"""One query for each operator of the engine over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.fixture import DAY_US, MODEM, RADIO, RUN_US, SCHEMAS, conversations, entries, runs, segments, store
from tidemark.functions import scalars
from tidemark.functions.render import rendered
from tidemark.functions.scratch import shared_folder
from tidemark.model import ENTRIES, ERROR, INFO, LEVELS, LOGS, SEVERITIES, TELEMETRY, WARN, as_entries, code, label
from tidemark.operators import enrich, ingest, limits, seeds, spans, storage, timeline
from tidemark.operators.reader import Reader, newest_segments
from tidemark.plans import query as plan
from tidemark.plans.query import NEWEST, OLDEST, BootTime, Query, Utc
from tidemark.schema import Migration, Range, Schema, dimensions
from tidemark.sources import parquet_store
from tidemark.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = f"""with e as (select event_id as seq, epoch_us(ts) as us, user_id, event_type, value, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from events),
r as (select *, cast((us-1704067200000000)//{RUN_US} as bigint) as boot from e),
entries as (select seq, boot, us-1704067200000000-boot*{RUN_US} as at_us, us, user_id, k,
  case when user_id%7<4 then 'orc-radio-'||cast(user_id%7 as varchar) else 'apt-modem-'||cast(user_id%7-4 as varchar) end as namespace,
  case when user_id%7<4 then 'radio' else 'modem' end as schema_name,
  case event_type when 'error' then 'critical' when 'purchase' then 'telemetry' else 'default' end as channel,
  case when event_type='purchase' then 'sample' else 'message' end as kind,
  case event_type when 'click' then (case when k>=95 then 99 else 1 end) when 'view' then 2 when 'signup' then 3 when 'error' then 4 end as event,
  case when event_type='purchase' then (case when k%4=0 then 2 else 1 end) end as metric,
  case when event_type='purchase' and k%4<>0 then value end as v_f64,
  case when event_type='purchase' and k%4=0 then cast(k%5 as bigint) end as v_u64,
  case when event_type<>'purchase' and k%3=0 then user_id+1 end as span,
  (us-1704067200000000-boot*{RUN_US})//{DAY_US}*{DAY_US} as base_us from r),
runs as (select b as boot, b//2 as hw_boot, 1000000+(b%2)*{RUN_US} as init_us, case when b//2<>1 then 1704067200000+(b//2)*864000000-1000 end as anchor_ms from range(6) t(b)),
d_events as (select * from (values ('radio',1,'Click',2,'ui'),('radio',2,'View',1,'ui'),('radio',3,'Signup',3,'account'),('radio',4,'Fault',5,'fault'),('modem',1,'Click',2,'ui'),('modem',2,'View',1,'ui'),('modem',3,'Signup',4,'account'),('modem',4,'Fault',5,'fault')) d(schema_name,event,name,level,tag)),
d_metrics as (select * from (values ('radio',1,'amount','EUR','gauge'),('radio',2,'link',null,'state'),('modem',1,'amount','EUR','gauge'),('modem',2,'rate','1/s','gauge')) d(schema_name,metric,metric_name,unit,metric_kind)),
d_states as (select * from (values ('radio',2,0,'Los',2),('radio',2,1,'Sync',1),('radio',2,2,'Lock',0)) d(schema_name,metric,state_code,state,state_severity)),
m as (select x.*, d.name, d.level, d.tag from entries x left join d_events d on x.schema_name=d.schema_name and x.event=d.event),
u as (select m.*, r.anchor_ms*1000+r.init_us+m.at_us as utc_us, r.anchor_ms, r.init_us from m left join runs r on m.boot=r.boot),
s as (select x.*, d.metric_name, d.unit, d.metric_kind, coalesce(x.v_f64, cast(x.v_u64 as double)) as number, t.state, case when d.metric_kind='state' then coalesce(t.state_severity,0) when coalesce(x.v_f64, cast(x.v_u64 as double))>200 and x.metric=1 then 2 when coalesce(x.v_f64, cast(x.v_u64 as double))>100 and x.metric=1 then 1 else 0 end as severity_code
  from entries x left join d_metrics d on x.schema_name=d.schema_name and x.metric=d.metric left join d_states t on x.schema_name=t.schema_name and x.metric=t.metric and x.v_u64=t.state_code where x.kind='sample'),
seg as (select namespace, channel, boot, base_us, min(at_us) as min_us, max(at_us) as max_us, count(*) as n_records, 8*count(*) as size from entries group by all),
c as (select conv_id+1 as span, (conv_id+1)//2 as half, conv_id*1000000+turn*1000 as at_us, role, text, turn, case when role='system' then 4 else 3 end as text_level from conversations)
"""
KEY = ["namespace", "channel", "boot", "at_us", "seq"]
KEYS = ", ".join(KEY)


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = BASE + sql
        return f

    return add


def _reader(spark: SparkSession, sf: str) -> Reader:
    return Reader(store(spark, sf), SCHEMAS)


def _run(spark: SparkSession, sf: str, q: Query, *columns: str) -> DataFrame:
    return _reader(spark, sf).matched(q).select(*KEY, *columns)


def _dims(spark: SparkSession):
    return dimensions(spark, SCHEMAS)


FROM = Utc(1_704_067_200_000_000)


@query(f"select {KEYS}, event, name, level, utc_us from u where kind='message' and namespace like 'orc-%' and coalesce(level,99)>=4 and utc_us>={FROM.us} order by boot, at_us, namespace, channel, seq limit 500")
def flagship(spark, sf):
    q = Query().group("orc-").min_level(WARN).kinds(*LOGS).since(FROM).order(OLDEST).limit(500)
    return _reader(spark, sf).query(q).entries.select(*KEY, "event", "name", "level", "utc_us")


# A. Scans


@query("select namespace, case when namespace like 'orc%' then 'radio' else 'modem' end as schema_name, string_agg(distinct channel, ',' order by channel) as channels, cast(sum(size) as bigint) as bytes from seg group by namespace")
def a3_namespaces(spark, sf):
    return _reader(spark, sf).namespaces().withColumn("channels", F.array_join("channels", ","))


@query("select namespace, channel, string_agg(printf('%08x-%016x.seg', boot, base_us), ',' order by boot, base_us) as names, cast(sum(size) as bigint) as bytes from seg group by namespace, channel")
def a4_inventory(spark, sf):
    named = segments(entries(spark, sf)).withColumn("name", scalars.segment_name(F.col("boot"), F.col("base_us")))
    out = named.groupBy("namespace", "channel").agg(F.array_sort(F.collect_list("name")).alias("names"), F.sum("size").alias("bytes"))
    return out.withColumn("names", F.array_join("names", ","))


@query("select printf('%08x-%016x.seg', boot, base_us) as name, boot, base_us from (select distinct boot, base_us from seg)")
def a5_segment_names(spark, sf):
    names = segments(entries(spark, sf)).select(scalars.segment_name(F.col("boot"), F.col("base_us")).alias("name")).distinct()
    return names.select("name", scalars.segment_boot(F.col("name")).alias("boot"), scalars.segment_base(F.col("name")).cast("bigint").alias("base_us"))


@query("select min(at_us) as first_us, count(*) as n from entries where boot%2=0")
def a16_own_records(spark, sf):
    s = store(spark, sf)
    s.entries, s.store_id = s.entries.withColumn("store_id", (7 + F.col("boot") % 2).cast("decimal(20,0)")), 7
    return Reader(s, SCHEMAS).selected(Query()).agg(F.min("at_us").alias("first_us"), F.count("*").alias("n"))


@query("select namespace||'/'||channel||'/'||printf('%08x-%016x.seg', boot, base_us) as path, cast(0 as bigint) as off, 'segment of another store' as reason from seg where boot%2=1")
def a17_damage(spark, sf):
    s = store(spark, sf)
    path = F.concat_ws("/", "namespace", "channel", scalars.segment_name(F.col("boot"), F.col("base_us")))
    s.segments, s.store_id = s.segments.withColumns({"store_id": (7 + F.col("boot") % 2).cast("decimal(20,0)"), "path": path}), 7
    return Reader(s, SCHEMAS).damage().select("path", F.col("offset").alias("off"), "reason")


@query("select namespace, channel, boot, base_us, bool_or(coalesce(metric=2,false)) as probe from entries group by all")
def a19_metric_probe(spark, sf):
    return segments(entries(spark, sf)).select("namespace", "channel", "boot", "base_us", storage.touches(None, metrics=[2]).alias("probe"))


# B. Projections


@query(f"select {KEYS}, event, name, level, coalesce(tag,'') as tags from m where kind='message'")
def b1_messages(spark, sf):
    return _run(spark, sf, Query().kinds("message"), "event", "name", "level", F.array_join("tags", ",").alias("tags"))


@query("select span, cast(1 as int) as span_kind, 'Conversation' as kind_name, min(at_us) as at_us, any_value(half) as parent from c group by span")
def b2_span_starts(spark, sf):
    return enrich.spans(conversations(spark, sf).where("kind = 'span_start'"), _dims(spark)).select("span", "span_kind", "kind_name", "at_us", "parent")


@query(f"select {KEYS}, metric, metric_name, unit, metric_kind from s")
def b3_samples(spark, sf):
    return _run(spark, sf, Query().kinds(*TELEMETRY), "metric", "metric_name", "unit", "metric_kind")


@query(f"select {KEYS}, v_u64 as state_code, case when metric_kind='state' then state end as state from s")
def b4_b5_state_labels(spark, sf):
    return _run(spark, sf, Query().kinds(*TELEMETRY), "state_code", "state")


@query(f"select {KEYS}, cast(severity_code as int) as severity_code, case severity_code when 0 then 'normal' when 1 then 'warn' else 'alarm' end as severity from s")
def b6_severity(spark, sf):
    return _run(spark, sf, Query().kinds(*TELEMETRY), "severity_code", "severity")


@query(f"select {KEYS}, number from s")
def b7_numbers(spark, sf):
    return _run(spark, sf, Query().kinds(*TELEMETRY), "number")


@query(f"select {KEYS}, utc_us, utc_us=us as exact from u")
def b8_utc(spark, sf):
    return _run(spark, sf, Query(), "utc_us", (F.col("utc_us") == F.col("us")).alias("exact"))


@query("select level, count(*) as n from (select level from m where kind='message' union all select text_level from c union all select null from s) t group by level")
def b9_effective_level(spark, sf):
    chat = enrich.messages(conversations(spark, sf).where("kind = 'text'").withColumn("event", F.lit(None).cast("int")), _dims(spark)).select(enrich.effective_level().alias("level"))
    return _reader(spark, sf).matched(Query()).select(enrich.effective_level().alias("level")).union(chat).groupBy("level").agg(F.count("*").alias("n"))


@query(f"select {KEYS}, case when event=1 then 'Klick '||k||' von '||user_id when event=2 then 'Ansicht' when event=3 then 'Anmeldung' when event=4 then 'Fehler '||k end as rendered from m")
def b10_rendered(spark, sf):
    return enrich.texts(_reader(spark, sf).matched(Query()), SCHEMAS, "de").select(*KEY, "rendered")


@query(f"select {KEYS}, case when event=1 then 'click '||k||' by '||user_id when event=2 then 'view' when event=3 then 'signup of '||lpad(cast(user_id as varchar),cast(greatest(6,length(cast(user_id as varchar))) as int),' ') when event=4 then 'fault {{'||k||'}}' end as rendered from m")
def b10_rendered_fallback(spark, sf):
    return enrich.texts(_reader(spark, sf).matched(Query()), SCHEMAS, "fr").select(*KEY, "rendered")


@query(f"select {KEYS}, case when event=1 then '{{\"k\":'||k||',\"user_id\":'||user_id||'}}' when event=3 then '{{\"user_id\":'||user_id||'}}' when event=4 then '{{\"k\":'||k||'}}' end as json from m")
def b11_json(spark, sf):
    return enrich.json_fields(_reader(spark, sf).matched(Query()), SCHEMAS).select(*KEY, "json")


@query(f"select {KEYS}, kind, name, level, cast(null as varchar) as metric_name, cast(null as varchar) as severity from m where kind='message' union all select {KEYS}, kind, null, null, metric_name, case severity_code when 0 then 'normal' when 1 then 'warn' else 'alarm' end from s")
def b13_entries(spark, sf):
    return _run(spark, sf, Query(), "kind", "name", "level", "metric_name", "severity")


@query("select seq, printf('#%d %02d:%02d:%02d.%03d_%03d', boot, at_us//3600000000, at_us//60000000%60, at_us//1000000%60, at_us//1000%1000, at_us%1000) as shown from entries")
def b14_boot_time(spark, sf):
    return entries(spark, sf).select("seq", scalars.boot_time(F.col("boot"), F.col("at_us")).alias("shown"))


# C. Filters


def _filtered(name: str, q: Query, where: str) -> None:
    def run(spark, sf):
        return _run(spark, sf, q, "kind")

    run.__name__ = name
    query(f"select {KEYS}, kind from u where {where}")(run)


_filtered("c1_names", Query().namespaces("orc-radio-1", "apt-modem-2"), "namespace in ('orc-radio-1','apt-modem-2')")
_filtered("c1_group", Query().group("apt-"), "namespace like 'apt-%'")
_filtered("c2_channels", Query().channel("critical").channel("telemetry"), "channel in ('critical','telemetry')")
_filtered("c3_boot", Query().boot(2), "boot=2")
_filtered("c4_relative_window", Query().range(BootTime(1, 3 * DAY_US), BootTime(3, DAY_US)), f"(boot>1 or (boot=1 and at_us>={3 * DAY_US})) and (boot<3 or (boot=3 and at_us<={DAY_US}))")
_filtered("c5_boot_window", Query().boot_window(4, DAY_US, 2 * DAY_US), f"boot=4 and at_us between {DAY_US} and {2 * DAY_US}")
_filtered("c6_wall_window", Query().range(Utc(FROM.us + 2 * DAY_US), Utc(FROM.us + 23 * DAY_US)), f"utc_us between {FROM.us + 2 * DAY_US} and {FROM.us + 23 * DAY_US}")
_filtered("c7_mixed_window", Query().range(BootTime(0, DAY_US), Utc(FROM.us + 22 * DAY_US)), f"(boot>0 or at_us>={DAY_US}) and utc_us<={FROM.us + 22 * DAY_US}")
_filtered("c10_min_level", Query().min_level(WARN), "kind<>'message' or coalesce(level,99)>=4")
_filtered("c11_any_tags", Query().any_tags("fault", "account"), "kind<>'message' or coalesce(tag,'') in ('fault','account')")
_filtered("c12_events", Query().event_ids(1, 99), "kind<>'message' or event in (1,99)")
_filtered("c13_event_names", Query().named("View", "Fault"), "kind<>'message' or coalesce(name,'') in ('View','Fault')")
_filtered("c14_spans", Query().in_spans(*range(1, 40)), "span between 1 and 39")
_filtered("c15_logs", Query().kinds(*LOGS), "kind in ('message','text')")
_filtered("c16_all_filters", Query().kinds("message").min_level(INFO).any_tags("account", "fault").event_ids(3, 4).named("Signup", "Fault"), "kind='message' and coalesce(level,99)>=3 and tag in ('account','fault') and event in (3,4) and name in ('Signup','Fault')")
_filtered("c20_metrics", Query().of_metrics(2), "kind<>'sample' or metric=2")


def _fit(q: Query):
    return lambda spark: timeline.run_bounds(timeline.anchors(*runs(spark)), q)


_WINDOW = Query().range(Utc(FROM.us + 2 * DAY_US), Utc(FROM.us + 21 * DAY_US))


@query(f"""select boot, case when anchor_ms is null then 'unanchored' when {_WINDOW.end.us}-anchor_ms*1000-init_us<0 then 'outside' else 'in' end as fit,
 case when anchor_ms is not null and {_WINDOW.end.us}-anchor_ms*1000-init_us>=0 and {_WINDOW.start.us}-anchor_ms*1000-init_us>=0 then {_WINDOW.start.us}-anchor_ms*1000-init_us end as low_us,
 case when anchor_ms is not null and {_WINDOW.end.us}-anchor_ms*1000-init_us>=0 then {_WINDOW.end.us}-anchor_ms*1000-init_us end as high_us from runs""")
def c8_run_bounds(spark, sf):
    return _fit(_WINDOW)(spark).select("boot", "fit", "low_us", "high_us")


@query("select seq, greatest(at_us-1,0) as before_us from entries")
def c9_just_before(spark, sf):
    return entries(spark, sf).select("seq", scalars.just_before(F.col("at_us")).alias("before_us"))


# A segment goes if the next one of its channel and run begins before the window: strictly, as times may repeat.
@query(f"select namespace, channel, boot, base_us from (select *, lead(base_us) over (partition by namespace, channel, boot order by base_us) as following from seg) t where base_us<={3 * DAY_US} and coalesce(following>={2 * DAY_US}, true)")
def c17_segment_pruning(spark, sf):
    return storage.in_window(segments(entries(spark, sf)), 2 * DAY_US, 3 * DAY_US).select("namespace", "channel", "boot", "base_us")


@query("select namespace, channel, boot, base_us, bool_or(coalesce(event in (4,99),false)) or bool_or(coalesce(metric=2,false)) as touched from entries group by all")
def c19_touches(spark, sf):
    return segments(entries(spark, sf)).select("namespace", "channel", "boot", "base_us", storage.touches(None, [4, 99], [2]).alias("touched"))


# D. Joins


@query("select namespace, metric, case when namespace='orc-radio-1' and metric=1 then 50.0 else (case when metric=1 then 100.0 end) end as warn_max, case when namespace='orc-radio-1' and metric=1 then 150.0 else (case when metric=1 then 200.0 end) end as alarm_max, coalesce(namespace='orc-radio-1' and metric=1, false) as overridden from (select distinct namespace, schema_name from entries) n join d_metrics d using (schema_name) where metric_kind<>'state'")
def d5_l5_effective_limits(spark, sf):
    r = _reader(spark, sf)
    return limits.effective(r.store.namespaces, r.dims.metrics, _overlay().tables(spark)[0]).select("namespace", "metric", "warn_max", "alarm_max", "overridden")


def _overlay() -> limits.Limits:
    by = {f"orc-radio-{i}": RADIO for i in range(4)} | {f"apt-modem-{i}": MODEM for i in range(3)}
    out = limits.Limits(by)
    out.set_ranges("orc-radio-1", 1, Range(None, 50), Range(None, 150))
    out.set_states("orc-radio-0", 2, {0: "normal", 2: "alarm"})
    return out


@query("""select seq, case when namespace='orc-radio-0' and metric_kind='state' then (case v_u64 when 0 then 0 when 1 then 1 when 2 then 2 else 0 end) when metric_kind='state' then severity_code
 when namespace='orc-radio-1' and metric=1 then (case when number>150 then 2 when number>50 then 1 else 0 end) else severity_code end as severity_code from s""")
def l6_severity_with_limits(spark, sf):
    dims = _dims(spark)
    rows = entries(spark, sf).where("kind = 'sample'").withColumns({"number": scalars.as_double(), "state_code": scalars.state_code()})
    return limits.with_limits(rows, dims.metrics, dims.states, _overlay().tables(spark)).select("seq", "severity_code")


@query("select distinct boot from entries where namespace like 'orc%' and boot in (2,3)")
def d8_unanchored(spark, sf):
    return _reader(spark, sf).query(Query().group("orc").since(FROM)).unanchored


_SEED = Query().since(BootTime(3, DAY_US)).with_state_seed()
_SEED_SQL = "select namespace, channel, metric, boot, at_us, v_u64 as state_code, {state} as state from (select *, row_number() over (partition by namespace,channel,metric order by boot desc, at_us desc, seq desc) rn from s where metric=2 {schema} and (boot<3 or (boot=3 and at_us<86400000000))) t where rn=1"


@query(_SEED_SQL.format(state="state", schema="and schema_name='radio'"))
def d9_f1_seeds(spark, sf):
    return _reader(spark, sf).query(_SEED).seeds.select("namespace", "channel", "metric", "boot", "at_us", "state_code", "state")


@query(_SEED_SQL.format(state="case when schema_name='radio' then state end", schema=""))
def d9_seeds_by_id(spark, sf):
    return _reader(spark, sf).seeds(_SEED, strict=True).select("namespace", "channel", "metric", "boot", "at_us", "state_code", "state")


@query(f"""select namespace, channel, metric, boot, at_us from (select s.*, row_number() over (partition by s.namespace,s.channel,metric order by boot desc, at_us desc, seq desc) rn from s
 join (select namespace, channel, min((boot, base_us)) as first from (select *, row_number() over (partition by namespace,channel order by boot desc, base_us desc) rn from seg where boot<3 or (boot=3 and base_us<={DAY_US})) where rn<=2 group by all) f on f.namespace=s.namespace and f.channel=s.channel
 where metric=2 and schema_name='radio' and (boot<3 or (boot=3 and at_us<{DAY_US})) and (boot, at_us)>=first) t where rn=1""")
def d9_seeds_of_newest_segments(spark, sf):
    return _reader(spark, sf).seeds(_SEED, max_segments=2).select("namespace", "channel", "metric", "boot", "at_us")


@query("select cast(0 as bigint) as boot, span, cast(nullif(any_value(half),0) as bigint) as parent, min(at_us) as start_us, max(at_us) as end_us, max(at_us)-min(at_us) as took_us from c group by span")
def d10_spans(spark, sf):
    return spans.spans(conversations(spark, sf)).select("boot", "span", "parent", "start_us", "end_us", "took_us")


@query("select boot, span, count(*) as n_records, count(case when kind='message' then 1 end) as n_messages from entries where span is not null group by boot, span")
def d10_span_contents(spark, sf):
    return spans.of_spans(entries(spark, sf))


@query(", t as (select distinct span from c) select span, cast(1 as bigint) as root, cast(floor(log2(span)) as int) as depth from t")
def d10_span_paths(spark, sf):
    return spans.paths(spans.spans(conversations(spark, sf))).select("span", "root", "depth")


# E. Aggregations


@query("select namespace, channel, boot, base_us, min_us, max_us, n_records, (select string_agg(distinct cast(event as varchar), ',' order by cast(event as varchar)) from entries x where x.namespace=seg.namespace and x.channel=seg.channel and x.boot=seg.boot and x.base_us=seg.base_us) as events from seg")
def e2_e3_w17_footers(spark, sf):
    out = segments(entries(spark, sf))
    ids = F.nullif(F.array_join(F.array_sort(F.col("events").cast("array<string>")), ","), F.lit(""))
    return out.select("namespace", "channel", "boot", "base_us", "min_us", "max_us", "n_records", ids.alias("events"))


@query("select max(boot)+1 as next_boot, max(hw_boot)+1 as next_hw_boot from runs")
def e4_w26_register(spark, sf):
    r, h = timeline.registered(*runs(spark), b"\x01" * 16, 5)
    return r.agg(F.max("boot").alias("next_boot"), F.max("hw_boot").alias("next_hw_boot"))


@query("select distinct schema_name, channel as store from entries where coalesce(event,0)<>99 or kind='sample'")
def e6_storage_classes(spark, sf):
    d = _dims(spark)
    return d.events.select("schema_name", "store").union(d.metrics.select("schema_name", "store")).union(d.spans.select("schema_name", "store")).distinct()


@query("select namespace, channel, min(boot) as first_boot from seg group by all")
def e7_first_boot(spark, sf):
    return segments(entries(spark, sf)).groupBy("namespace", "channel").agg(F.min("boot").alias("first_boot"))


@query("select count(*) as n_records, count(case when kind='message' then 1 end) as n_message, count(case when kind='sample' then 1 end) as n_sample, count(case when event=99 then 1 end) as n_rejected from entries")
def e8_w31_counters(spark, sf):
    return ingest.counters(entries(spark, sf), _dims(spark)).select("n_records", "n_message", "n_sample", "n_rejected")


# What the schemas don't declare, and values of another type, are dropped on writing.
@query("select namespace, channel, count(*) as n from entries where event=99 or metric=2 and schema_name='modem' group by all")
def e9_drops(spark, sf):
    return _dropped(spark, sf).groupBy("namespace", "channel").agg(F.count("*").alias("n"))


def _dropped(spark, sf) -> DataFrame:
    """Records that the write side rejects, were the modem's metric 2 declared as a double."""
    modem = replace(MODEM, metrics=tuple(replace(m, vtype="f64") if m.id == 2 else m for m in MODEM.metrics))
    return ingest.violations(entries(spark, sf), dimensions(spark, [RADIO, modem])).where("violation is not null")


@query("select count(*) as n from u where coalesce(level,99)>=4 and kind='message'")
def e10_cardinality(spark, sf):
    return _reader(spark, sf).matched(Query().kinds("message").min_level(WARN)).agg(F.count("*").alias("n"))


@query("select namespace, metric, boot, at_us//3600000000*3600000000 as bucket_us, count(*) as n, min(number) as low, max(number) as high, round(sum(number),6) as total from s group by all")
def e11_rollup(spark, sf):
    rows = entries(spark, sf).where("kind = 'sample'").withColumn("number", scalars.as_double())
    return seeds.rolled_up(rows, 3_600_000_000).withColumn("total", F.round("total", 6))


# F. Windows


@query(f"select {KEYS.replace('at_us', 'max(at_us+(seq*7919%100000)*1000000) over (partition by namespace,channel,boot order by seq) as at_us')} from entries")
def f2_w12_monotone(spark, sf):
    late = entries(spark, sf).withColumn("at_us", F.col("at_us") + F.col("seq") * 7919 % 100_000 * 1_000_000)
    return ingest.monotone(late).select(*KEY)


@query("select seq, coalesce(greatest(at_us-lag(at_us) over (partition by namespace,channel,boot,base_us order by seq),0),0) as delta_us from entries")
def f3_w13_deltas(spark, sf):
    return storage.deltas(entries(spark, sf)).select("seq", "delta_us")


@query("select seq, at_us from entries")
def a10_absolute_times(spark, sf):
    first = F.min("at_us").over(Window.partitionBy("namespace", "channel", "boot", "base_us"))
    return storage.absolute(storage.deltas(entries(spark, sf)).withColumn("base_us", F.col("base_us")).withColumn("start", first).withColumn("delta_us", F.when(F.col("at_us") == F.col("start"), F.col("at_us") - F.col("base_us")).otherwise(F.col("delta_us")))).select("seq", "at_us")


def _syncs(spark, sf):
    return entries(spark, sf).where("channel = 'critical'").select(F.call_function("div", F.col("boot"), F.lit(2).cast("bigint")).alias("hw_boot"), F.col("seq").alias("arrival"), (F.col("seq") * 7 % 4).cast("int").alias("source"), F.when(F.col("seq") % 5 == 0, F.lit(5).cast("bigint")).otherwise(F.call_function("div", F.col("us"), F.lit(1000).cast("bigint"))).alias("utc_ms"))


_SYNCS = ", y as (select boot//2 as hw_boot, seq as arrival, cast(seq*7%4 as int) as source, case when seq%5=0 then 5 else us//1000 end as utc_ms from entries where channel='critical'), ok as (select *, utc_ms>=1000000000000 and utc_ms<4102444800000 as usable from y)"


@query(_SYNCS + " select hw_boot, arrival, usable and source=max(case when usable then source end) over (partition by hw_boot order by arrival) as accepted from ok")
def f4_accepted_syncs(spark, sf):
    return timeline.accepted_syncs(_syncs(spark, sf)).select("hw_boot", "arrival", "accepted")


@query(_SYNCS + " select hw_boot, utc_ms as anchor_ms, source from (select *, row_number() over (partition by hw_boot order by source desc, arrival desc) rn from ok where usable) t where rn=1")
def f4_w27_anchors(spark, sf):
    return timeline.final_anchors(_syncs(spark, sf))


@query(", b as (select *, row_number() over (partition by namespace,channel,boot,base_us order by seq) as off, row_number() over (partition by namespace,channel,boot,base_us order by seq)+(seq//500) as block_seq from entries) select namespace, channel, boot, base_us, block_seq, next_seq from (select *, lead(block_seq) over (partition by namespace,channel,boot,base_us order by off) as next_seq from b) t where next_seq<>block_seq+1")
def f5_w21_gaps(spark, sf):
    rank = F.row_number().over(Window.partitionBy(*storage.SEGMENT).orderBy("seq"))
    blocks = entries(spark, sf).withColumn("offset", rank).withColumn("block_seq", rank + F.call_function("div", F.col("seq"), F.lit(500).cast("bigint")))
    return storage.gaps(blocks).select(*storage.SEGMENT, "block_seq", "next_seq")


@query("select namespace, channel, boot, base_us from (select *, sum(size) over (partition by namespace,channel order by boot desc, base_us desc rows unbounded preceding) as kept, row_number() over (partition by namespace,channel order by boot desc, base_us desc) as age from seg) t where kept>400 and age>1")
def f6_w20_rotation(spark, sf):
    return storage.over_budget(segments(entries(spark, sf)), F.lit(400)).select(*storage.SEGMENT)


@query(f"select {KEYS}, lead(at_us) over (partition by namespace,metric,boot order by at_us,channel,seq) as until_us from s where metric=2")
def f7_state_intervals(spark, sf):
    return seeds.holding(entries(spark, sf).where("metric = 2")).select(*KEY, "until_us")


@query(f"select {KEYS}, number-lag(number) over (partition by namespace,metric,boot order by at_us,channel,seq) as delta, at_us-lag(at_us) over (partition by namespace,metric,boot order by at_us,channel,seq) as delta_us from s")
def f7_derivative(spark, sf):
    return seeds.derivative(entries(spark, sf).where("kind = 'sample'").withColumn("number", scalars.as_double())).select(*KEY, "delta", "delta_us")


# G. Order and limits


@query(f"select {KEYS} from entries order by boot, at_us, namespace, channel, seq limit 250")
def g1_oldest(spark, sf):
    return _reader(spark, sf).query(Query().order(OLDEST).limit(250)).entries.select(*KEY)


@query(f"select {KEYS} from entries order by boot desc, at_us desc, namespace, channel, seq desc limit 250")
def g2_newest(spark, sf):
    return _reader(spark, sf).query(Query().order(NEWEST).limit(250)).entries.select(*KEY)


@query("select count(*)>=100 as full_page, count(*)>=10000000 as beyond, least(count(*), 100) as n from entries")
def g3_truncated(spark, sf):
    r = _reader(spark, sf)
    full, all_of = r.query(Query().limit(100)), r.query(Query().limit(10_000_000))
    return spark.createDataFrame([(full.truncated, all_of.truncated, full.entries.count())], "full_page boolean, beyond boolean, n bigint")


@query("select namespace, channel, boot, base_us from (select *, row_number() over (partition by namespace,channel order by boot desc, base_us desc) rn from seg) t where rn<=2")
def g6_newest_segments(spark, sf):
    return newest_segments(segments(entries(spark, sf)), 2).select(*storage.SEGMENT)


@query(f"select {KEYS} from (select *, row_number() over (order by boot desc, at_us desc, namespace, channel, seq desc) rn from entries) t where rn between 101 and 200")
def g10_next_page(spark, sf):
    r = _reader(spark, sf)
    last = r.query(Query().limit(100)).entries.select("boot", "at_us", "namespace", "channel", "seq").orderBy("boot", "at_us").first()
    return r.query(Query().limit(100).page_after(*last)).entries.select(*KEY)


@query(f"select {KEYS}, row_number() over (partition by namespace, channel, boot order by at_us, seq) as place from entries")
def g8_w11_batch_order(spark, sf):
    place = F.row_number().over(Window.partitionBy("namespace", "channel", "boot").orderBy("at_us", "seq"))
    return entries(spark, sf).withColumn("place", place).select(*KEY, "place")


# H. Sets


@query("select kind, count(*) as n from (select kind from entries union all select 'text' from c union all select 'span_start' from (select distinct span from c) union all select 'span_end' from (select distinct span from c)) t group by kind")
def h1_union(spark, sf):
    return entries(spark, sf).select("kind").union(conversations(spark, sf).select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("select distinct boot from entries where boot in (2,3)")
def h3_unanchored_union(spark, sf):
    r = _reader(spark, sf)
    a = [r.query(Query().channel(c).since(FROM)).unanchored for c in ("default", "critical")]
    return a[0].union(a[1]).distinct()


# I. Scalars


@query("select seq, case when v>=0 then 2*v else -2*v-1 end as zig, v as back from (select seq, case when seq%2=0 then at_us else -at_us end as v from entries) t")
def i5_zigzag(spark, sf):
    v = F.when(F.col("seq") % 2 == 0, F.col("at_us")).otherwise(-F.col("at_us"))
    return entries(spark, sf).select("seq", scalars.zigzag(v).alias("zig")).withColumn("back", scalars.unzigzag(F.col("zig")))


@query("select seq, case when at_us>9223372036854775807-seq*100000000000000 then 9223372036854775807 else at_us+seq*100000000000000 end as up, greatest(at_us-seq*100000000,0) as down from entries")
def i9_saturating(spark, sf):
    step = lambda unit: scalars.saturating_multiply(F.col("seq"), F.lit(unit).cast("bigint"))
    return entries(spark, sf).select("seq", scalars.saturating_add(F.col("at_us"), step(100_000_000_000_000)).alias("up"), scalars.saturating_subtract(F.col("at_us"), step(100_000_000)).alias("down"))


@query("select seq, case when anchor_ms is not null and us-anchor_ms*1000-init_us>=0 then us-anchor_ms*1000-init_us end as rel, anchor_ms is not null as anchored from u")
def i10_i11_relative(spark, sf):
    rows = entries(spark, sf).join(timeline.anchors(*runs(spark)), "boot")
    return rows.select("seq", scalars.relative_us(F.col("us"), F.col("anchor_ms"), F.col("init_us")).alias("rel"), F.col("anchor_ms").isNotNull().alias("anchored"))


@query("select seq, case when seq%3=0 then null else upper(md5(cast(seq as varchar))) end as id from entries")
def i12_uuid(spark, sf):
    h = F.md5(F.col("seq").cast("string").cast("binary"))
    text = F.when(F.col("seq") % 3 == 0, F.lit("not-a-uuid")).otherwise(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 20)))
    return entries(spark, sf).select("seq", F.hex(scalars.uuid_bytes(text)).alias("id"))


@query("select seq, us//1000*(seq%4)>=1000000000000 and us//1000*(seq%4)<4102444800000 as plausible from entries")
def i13_plausible(spark, sf):
    ms = F.call_function("div", F.col("us"), F.lit(1000).cast("bigint")) * (F.col("seq") % 4)
    return entries(spark, sf).select("seq", scalars.plausible_utc(ms).alias("plausible"))


@query("select distinct x as name, regexp_full_match(x,'[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}') and not regexp_matches(x,'\\.(tmp|seg|corrupt)$') as valid from (select namespace x from entries union all select '.'||namespace from entries union all select namespace||'.seg' from entries union all select namespace||'/'||channel from entries union all select repeat(namespace,8) from entries) t")
def i14_path_components(spark, sf):
    n = F.col("namespace")
    names = entries(spark, sf).select(F.explode(F.array(n, F.concat(F.lit("."), n), F.concat(n, F.lit(".seg")), F.concat(n, F.lit("/"), "channel"), F.repeat(n, F.lit(8)))).alias("name")).distinct()
    return names.select("name", scalars.valid_component(F.col("name")).alias("valid"))


@query("select name, lvl, cast(level as int) as back, sev from (select distinct name, level, case level when 1 then 'Trace' when 2 then 'Debug' when 3 then 'Info' when 4 then 'Warn' when 5 then 'Error' end as lvl, case level when 1 then 'warn' when 2 then 'alarm' end as sev from m where level is not null) t")
def i15_labels(spark, sf):
    rows = _reader(spark, sf).matched(Query().kinds("message")).where("level is not null").select("name", "level").distinct()
    return rows.select("name", label(F.col("level"), LEVELS).alias("lvl"), label(F.col("level"), SEVERITIES).alias("sev")).withColumn("back", code(F.col("lvl"), LEVELS))


@query("select seq, case when span%5=0 then null else span end as span_id from entries where span is not null")
def i20_span_ids(spark, sf):
    return entries(spark, sf).where("span is not null").select("seq", scalars.span_or_none(F.when(F.col("span") % 5 == 0, F.lit(0)).otherwise(F.col("span"))).alias("span_id"))


# W. The write side


@query("select seq, case when event=99 then null else channel end as channel from entries")
def w10_routing(spark, sf):
    return ingest.routed(entries(spark, sf).drop("channel"), _dims(spark)).select("seq", "channel")


@query("select span, turn, 'default' as channel from c where text_level<5")
def w6_text_routing(spark, sf):
    texts = conversations(spark, sf).where("kind = 'text'").withColumns({c: F.lit(None).cast("int") for c in ("event", "metric", "span_kind")})
    turn = F.call_function("div", F.col("at_us") % 1_000_000, F.lit(1000).cast("bigint"))
    return ingest.routed(texts.withColumn("turn", turn), _dims(spark)).where(F.col("text_level") < ERROR).select("span", "turn", "channel")


@query("select namespace, channel, boot, max(at_us) as at_us, cast(5 as tinyint) as text_level, 'tidemark' as target, count(*)||' records dropped' as text from entries where event=99 or metric=2 and schema_name='modem' group by namespace, channel, boot")
def w24_drop_notices(spark, sf):
    return ingest.drop_notices(_dropped(spark, sf)).drop("kind")


@query("select namespace, 'unknown_event' as violation, count(*) as n from entries where event=99 group by namespace")
def w25_announcements(spark, sf):
    return ingest.announcements(ingest.violations(entries(spark, sf), _dims(spark)).where("violation is not null"))


@query("select boot, hw_boot from runs where boot in (select boot from seg where boot<>1) or boot=5")
def w28_retention(spark, sf):
    r, h = timeline.retained(*runs(spark), segments(entries(spark, sf)).where("boot <> 1"), current=5)
    return r.join(h, "hw_boot", "left_semi").select("boot", "hw_boot")


@query("select namespace, channel, least(greatest(sum(size)*100000//256,4194304),268435456) as segment_size from seg group by all")
def w30_segment_sizes(spark, sf):
    budgets = segments(entries(spark, sf)).groupBy("namespace", "channel").agg(F.sum("size").alias("bytes"))
    return budgets.select("namespace", "channel", scalars.segment_size(F.col("bytes") * 100_000).alias("segment_size"))


@query("select namespace, violation, sum(n) as n from (select namespace, 'unknown_event' as violation, 1 as n from entries where event=99) t group by all")
def l1_undeclared(spark, sf):
    d = _dims(spark).events.select("schema_name", "event")
    lost = entries(spark, sf).where("kind = 'message'").join(d, ["schema_name", "event"], "left_anti")
    return lost.groupBy("namespace").agg(F.count("*").alias("n")).withColumn("violation", F.lit("unknown_event"))


@query("select seq, cast(row_number() over (partition by boot order by namespace, at_us, seq) as bigint) as span from entries")
def w9_span_ids(spark, sf):
    return spans.allocated(entries(spark, sf).drop("span")).select("seq", "span")


@query(""", w as (select span-1 as work, case when half>0 then half-1 end as within, min(at_us) as start_us, max(at_us) as end_us from c group by all),
i as (select *, row_number() over (order by start_us, work) as id from w)
select i.id as span, 'span_start' as kind, i.start_us as at_us, p.id as parent from i left join i p on p.work=i.within union all select id, 'span_end', end_us, null from i""")
def w8_span_records(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    at = F.col("conv_id") * 1_000_000 + F.col("turn") * 1000
    half = F.call_function("div", F.col("conv_id") + 1, F.lit(2).cast("bigint"))
    works = c.groupBy(F.col("conv_id").alias("work"), F.when(half > 0, half - 1).alias("within")).agg(F.min(at).alias("start_us"), F.max(at).alias("end_us"))
    works = works.select("*", F.lit(0).cast("bigint").alias("boot"), F.lit("apt-chat-0").alias("namespace"), F.lit("radio").alias("schema_name"), F.lit(1).alias("span_kind"), F.col("work").alias("seq"))
    return ingest.routed(spans.recorded(works).withColumns({"event": F.lit(None).cast("int"), "metric": F.lit(None).cast("int"), "text_level": F.lit(None).cast("tinyint")}), _dims(spark)).select("span", "kind", "at_us", "parent")


@query("select seq, case when boot=0 and event=1 then 2 else event end as event from entries where not (boot=0 and coalesce(event,0)=4)")
def k4_read_of_earlier_versions(spark, sf):
    """Records of run 0 are of version 1 of both schemas; version 2 has clicks as views and no faults."""
    steps = (Migration(1, lambda d: d.withColumn("event", F.when(F.col("event") == 1, 2).otherwise(F.col("event"))).where("event <> 4"), events=(1, 4)),)
    s = store(spark, sf)
    s.entries = s.entries.withColumn("protocol_version", F.when(F.col("boot") == 0, 1).otherwise(2))
    return Reader(s, [replace(x, version=2, migrations=steps) for x in SCHEMAS]).matched(Query()).select("seq", "event")


@query("select namespace, case when namespace like 'orc%' then 'radio' else 'modem' end as schema_name from (select distinct namespace from entries)")
def a15_schema_of_namespaces(spark, sf):
    return _reader(spark, sf).matched(Query()).select("namespace", "schema_name").distinct()


@query("""select seq, case when v_f64 is not null then 'amount '||printf('%.2f', v_f64)||' of '||(case when v_f64=floor(v_f64) then cast(cast(v_f64 as bigint) as varchar) else cast(v_f64 as varchar) end) end as shown from entries""")
def i3_formatted_numbers(spark, sf):
    value = F.struct(F.col("v_f64").alias("v"))
    return entries(spark, sf).select("seq", F.when(F.col("v_f64").isNotNull(), rendered("amount {v:.2} of {v}", {"v": "double"}, value)).alias("shown"))


@query("select seq from entries order by seq limit 500")
def g4_lazy_stream(spark, sf):
    """The first records of a stream, which is read a partition at a time."""
    rows = islice(_reader(spark, sf).stream(Query().order(OLDEST)), 500)
    return spark.createDataFrame([(r.seq,) for r in rows], "seq bigint")


@query("select seq, case when event=1 then 2 else event end as event, case when metric=1 then v_f64/100 else v_f64 end as v_f64 from entries where event is distinct from 4")
def k4_migration(spark, sf):
    merge = Migration(1, lambda d: d.withColumn("event", F.lit(2)), events=(1,))
    scale = Migration(2, lambda d: d.withColumn("v_f64", F.col("v_f64") / 100), metrics=(1,))
    drop = Migration(3, lambda d: d.limit(0), events=(4,))
    return Schema("radio", 4, migrations=(merge, scale, drop)).migrate(entries(spark, sf), from_version=1).select("seq", "event", "v_f64")


@query("select seq, case when seq%4=0 then 'wrong_type' end as violation from entries where kind='sample'")
def i19_value_types(spark, sf):
    rows = entries(spark, sf).where("kind = 'sample'").withColumn("vtype", F.when(F.col("seq") % 4 == 0, "f32").otherwise(F.col("vtype")))
    return ingest.violations(rows, _dims(spark)).select("seq", "violation")


@query("select boot, hw_boot, init_us, anchor_ms from runs")
def d3_run_anchors(spark, sf):
    r, h = runs(spark)
    return timeline.anchors(r, h).join(r.select("boot", "hw_boot"), "boot").select("boot", "hw_boot", "init_us", "anchor_ms")


@query("select channel, kind, count(*) as n, bool_and(namespace like 'orc-radio-_' or namespace like 'apt-modem-_') as named from entries group by all")
def b12_places(spark, sf):
    named = F.col("namespace").rlike("^(orc-radio|apt-modem)-.$")
    return _reader(spark, sf).selected(Query()).groupBy("channel", "kind").agg(F.count("*").alias("n"), F.bool_and(named).alias("named"))


# On disk: what the write side has stored, opened again.


_STORED = ", k as (select * replace (max(at_us) over (partition by namespace,channel,boot order by seq) as at_us) from m where coalesce(event,0)<>99)"


def _on_disk(spark: SparkSession, sf: str) -> str:
    """The folder of a new store with all records that the schemas allow."""
    root, source = shared_folder(spark), store(spark, sf)
    parquet_store.create(spark, root)
    by_name = {s.name: s for s in SCHEMAS}
    for name, schema in source.namespaces.collect():  # the catalogue
        parquet_store.add_namespace(spark, root, name, by_name[schema])
    ingest.ingest(entries(spark, sf), _dims(spark), f"{root}/entries")
    parquet_store.save_runs(*runs(spark), root, "0")
    return root


@query(f"{_STORED} select namespace, channel, boot, min(at_us) as min_us, max(at_us) as max_us, count(*) as n_records, true as own, false as damaged from k group by all")
def w5_stored_segments(spark, sf):
    """Files of an opened store by place; own: its identity is the one that its creation gave."""
    root = _on_disk(spark, sf)
    s, own = parquet_store.open_store(spark, root), parquet_store.create(spark, root)
    places = s.segments.groupBy("namespace", "channel", "boot").agg(F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us"), F.sum("n_records").alias("n_records"))
    return places.withColumns({"own": F.lit(s.store_id == own), "damaged": F.lit(not Reader(s, SCHEMAS).damage().isEmpty())})


@query(f"{_STORED} select {KEYS}, name, level, utc_us from (select k.*, r.anchor_ms*1000+r.init_us+at_us as utc_us from k join runs r on k.boot=r.boot) t where utc_us>={FROM.us + RUN_US // 3} and utc_us<={FROM.us + RUN_US + RUN_US // 2} and (kind<>'message' or level>=3)")
def c6_stored_wall_window(spark, sf):
    """A wall-clock window and a level over an opened store, where both prune partitions and row groups."""
    q = Query().range(Utc(FROM.us + RUN_US // 3), Utc(FROM.us + RUN_US + RUN_US // 2)).min_level(INFO)
    return Reader(parquet_store.open_store(spark, _on_disk(spark, sf)), SCHEMAS).query(q).entries.select(*KEY, "name", "level", "utc_us")


@query(f"{_STORED} select namespace, schema_name, string_agg(distinct channel, ',' order by channel) as channels, true as has_bytes from k group by all")
def a3_stored_namespaces(spark, sf):
    out = Reader(parquet_store.open_store(spark, _on_disk(spark, sf)), SCHEMAS).namespaces()
    return out.select("namespace", "schema_name", F.array_join("channels", ",").alias("channels"), (F.col("bytes") > 0).alias("has_bytes"))


@query(f"{_STORED} select boot, count(*) as n from k group by boot")
def a14_stored_without_runs(spark, sf):
    """Run tables that aren't there are empty ones: records are read, and a wall-clock window names every run as unanchored."""
    r = Reader(parquet_store.open_store(spark, _on_disk(spark, sf), version="none"), SCHEMAS)
    return r.matched(Query()).groupBy("boot").agg(F.count("*").alias("n")).join(r.query(Query().since(FROM)).unanchored, "boot", "left_semi")


# J. Streams, each over two arrivals of all records


def _streamed(spark: SparkSession, records: DataFrame, started: Callable[[DataFrame, str, str], None]) -> str:
    """Lets records arrive in two parts by seq; `started` runs a stream over what has come, with a folder for its output and one for its progress. Returns the output folder."""
    source, out, progress = (shared_folder(spark) for _ in range(3))
    middle = records.agg(F.call_function("div", F.max("seq"), F.lit(2).cast("bigint"))).first()[0]
    for part in (records.where(F.col("seq") <= middle), records.where(F.col("seq") > middle)):
        as_entries(part).write.mode("append").parquet(source)
        started(live.live(spark, source, max_files=1_000_000), out, progress)
    return out


@query(SQL["f2_w12_monotone"].removeprefix(BASE))
def j2_live_monotone(spark, sf):
    late = entries(spark, sf).withColumn("at_us", F.col("at_us") + F.col("seq") * 7919 % 100_000 * 1_000_000)

    def started(rows: DataFrame, out: str, progress: str) -> None:
        clamped = live.monotone(rows.select(*KEY))
        clamped.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()

    return spark.read.schema(", ".join(f"{c} {ENTRIES[c]}" for c in KEY)).parquet(_streamed(spark, late, started))


@query("select us//3600000000*3600000000 as from_us, namespace, kind, count(*) as n from entries group by all")
def j1_live_counts(spark, sf):
    def started(rows: DataFrame, out: str, progress: str) -> None:
        counted = live.counts(rows.withColumn("utc", F.timestamp_micros(F.col("boot") * RUN_US + F.col("at_us") + FROM.us)))
        save = lambda batch, _: batch.select(F.unix_micros("window.start").alias("from_us"), "namespace", "kind", "n").write.mode("overwrite").parquet(out)
        counted.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()

    return spark.read.parquet(_streamed(spark, entries(spark, sf), started))


__all__ = ["QUERIES", "SQL", "plan"]
