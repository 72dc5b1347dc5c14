import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.render import as_json, formatted, parts, placeholders, rendered

LOOSE = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_template_parts():
    assert parts("a {x} {{b}} {y:.1}!") == ["a ", ("x", ""), " ", "{", "b", "}", " ", ("y", ".1"), "!"]
    assert placeholders("{a}{b:>5}") == ["a", "b"]
    assert parts("open {brace") == ["open {brace"] and parts("") == []
    assert parts("тепло {t:.1} °C") == ["тепло ", ("t", ".1"), " °C"]


def test_rendered(spark):
    df = spark.createDataFrame([((87.25, 3, "x", True, 30.0, 1e16),)], "f struct<t:double,s:int,n:string,b:boolean,g:float,h:double>")
    text = lambda t, k: df.select(rendered(t, {"t": "double", "s": "int", "n": "string", "b": "boolean", "g": "float", "h": "double"}, F.col("f")).alias("r")).first().r
    assert text("overheat: {t:.1} °C on {s}", 0) == "overheat: 87.2 °C on 3"
    assert text("{g} {h} {b} {n:>3}|{s:<3}|{n:^3}", 0) == "30 10000000000000000 true   x|3  | x "
    with pytest.raises(ValueError):
        formatted(F.col("f"), "int", "x")


def test_special_numbers(spark):
    df = spark.createDataFrame([(float("nan"), float("inf")), (-float("inf"), None)], "a double, b double")
    rows = df.select(formatted(F.col("a"), "double").alias("a"), formatted(F.col("b"), "double", ".2").alias("b")).collect()
    assert [tuple(r) for r in rows] == [("NaN", "inf"), ("-inf", None)]
    j = df.select(as_json(F.struct("a", "b"), {"a": "double", "b": "double"}).alias("j")).collect()
    assert [r.j for r in j] == ['{"a":null,"b":null}'] * 2


@LOOSE
@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), min_size=1, max_size=20))
def test_shortest_floats_round_trip(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v float").select("v", formatted(F.col("v"), "float").alias("s")).collect()
    for r in rows:
        assert struct.pack("f", float(r.s)) == struct.pack("f", r.v) and "e" not in r.s.lower()


@LOOSE
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20))
def test_zigzag_round_trips(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("z", scalars.zigzag(F.col("v"))).withColumn("b", scalars.unzigzag(F.col("z"))).collect()
    for r in rows:
        assert r.b == r.v and r.z % 2**64 == (2 * r.v if r.v >= 0 else -2 * r.v - 1) % 2**64


@LOOSE
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**63 - 1)), min_size=1, max_size=20))
def test_segment_names_round_trip_in_order(spark, values):
    rows = spark.createDataFrame(values, "boot bigint, base bigint").withColumn("n", scalars.segment_name(F.col("boot"), F.col("base")))
    rows = rows.select("*", scalars.segment_boot(F.col("n")).alias("b"), scalars.segment_base(F.col("n")).alias("t")).collect()
    assert all((r.b, int(r.t)) == (r.boot, r.base) for r in rows)
    assert [r.n for r in sorted(rows, key=lambda r: (r.boot, r.base))] == sorted(r.n for r in rows)


def test_names_that_are_no_segments(spark):
    names = ["00000001-0000000000000002.SEG", "1-2.seg", "0000000A-0000000000000002.seg", "00000001-0000000000000002.seg.tmp", ""]
    assert all(r.b is None for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalars.segment_boot(F.col("n")).alias("b")).collect())


def test_overflow_is_null_or_saturates(spark):
    top = 2**63 - 1
    r = spark.createDataFrame([(top, 5)], "a bigint, b bigint").select(
        scalars.utc_us(F.col("a"), F.col("b"), F.col("b")).alias("u"), scalars.saturating_add(F.col("a"), F.col("b")).alias("s"), scalars.saturating_subtract(F.col("b"), F.col("a")).alias("d")
    )
    assert tuple(r.first()) == (None, top, 0)
    shown = spark.createDataFrame([(3, 3_723_456_789)], "b bigint, t bigint").select(scalars.boot_time(F.col("b"), F.col("t")).alias("x")).first().x
    assert shown == "#3 01:02:03.456_789"


def test_nan_leaves_any_bounds(spark):
    df = spark.createDataFrame([(float("nan"),), (71.0,), (-5.0,), (70.0,), (0.0,)], "v double")
    out = [r.o for r in df.select(scalars.outside(F.col("v"), F.lit(0.0), F.lit(70.0)).alias("o")).collect()]
    assert out == [True, True, True, False, False]
    assert not df.where(scalars.outside(F.col("v"), F.lit(None).cast("double"), F.lit(None).cast("double"))).count()
