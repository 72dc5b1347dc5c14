import pytest

from tidemark.model import ERROR, INFO
from tidemark.schema import Event, Metric, Migration, Range, Schema, SchemaError, Span, State

OK = {"name": "s", "events": (Event(2, "B", ERROR), Event(1, "A", INFO, templates={"en": "a {x}"}, fields={"x": "int"}))}


def test_parts_are_sorted_and_found():
    s = Schema(**OK, metrics=(Metric(3, "m"),), spans=(Span(4, "p", "slow"),))
    assert [e.id for e in s.events] == [1, 2]
    assert s.event("B").id == s.event(2).id == 2 and s.metric(3).name == "m" and s.span("p").id == 4 and s.event(9) is None
    assert s.stores() == ["default", "slow"] and s.language("xx") == "en"


@pytest.mark.parametrize(
    "broken",
    [
        {"name": ""},
        {"name": "s", "version": 0},
        {"name": "s", "languages": ()},
        {"name": "s", "languages": ("en", "en")},
        {"name": "s", "events": (Event(1, "A", INFO), Event(1, "B", INFO))},
        {"name": "s", "events": (Event(1, "A", INFO, templates={"de": "a"}),)},
        {"name": "s", "events": (Event(1, "A", INFO, templates={"en": "{y}"}, fields={"x": "int"}),)},
        {"name": "s", "metrics": (Metric(1, "m", "u64", "state"),)},
        {"name": "s", "metrics": (Metric(1, "m", "f64", "state", states=(State(0, "a"),)),)},
        {"name": "s", "metrics": (Metric(1, "m", "u64", "state", warn=Range(0, 1), states=(State(0, "a"),)),)},
        {"name": "s", "metrics": (Metric(1, "m", "u64", "state", states=(State(0, "a"), State(0, "b"))),)},
        {"name": "s", "metrics": (Metric(1, "m", "bool", "state", states=(State(2, "a"),)),)},
        {"name": "s", "metrics": (Metric(1, "m", "u64", "state", states=(State(0, "a", "critical"),)),)},
        {"name": "s", "metrics": (Metric(1, "m", warn=Range(2, 1)),)},
        {"name": "s", "metrics": (Metric(1, "m", warn=Range(float("nan"))),)},
        {"name": "s", "metrics": (Metric(1, "m", warn=Range(0, 10), alarm=Range(0, 5)),)},
        {"name": "s", "metrics": (Metric(1, "m", "blob", warn=Range(0)),)},
        {"name": "s", "version": 3, "migrations": (Migration(1, lambda d: d),)},
        {"name": "s", "version": 2, "migrations": (Migration(1, lambda d: d), Migration(1, lambda d: d))},
    ],
)
def test_broken_schemas_are_refused(broken):
    with pytest.raises(SchemaError):
        Schema(**broken)


def test_ranges():
    assert Range.parse("..=70") == Range(None, 70) and Range.parse("-10..=85") == Range(-10, 85) and Range.parse("5..") == Range(5)
    with pytest.raises(SchemaError):
        Range.parse("0..70")


def test_one_sided_nesting_is_allowed():
    Metric(1, "m", warn=Range(None, 70), alarm=Range(-10, 85)).check()


def test_migrations_touch_what_they_name(spark):
    from pyspark.sql import functions as F

    s = Schema("s", 3, migrations=(Migration(1, lambda d: d.withColumn("event", F.col("event") + 10), events=(1,)), Migration(2, lambda d: d.where("event <> 2"), events=(2,))))
    rows = spark.createDataFrame([(1, None), (2, None), (3, None), (None, 7)], "event int, metric int")
    migrated = lambda v: sorted((r.event for r in s.migrate(rows, v).collect()), key=lambda x: x or 0)
    assert migrated(1) == [None, 3, 11]
    assert migrated(2) == [None, 1, 3]
    assert migrated(3) == [None, 1, 2, 3]
