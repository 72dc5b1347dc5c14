"""Scalar functions on records: times, names, identifiers and numbers. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_US = 2**63 - 1


def as_double() -> Column:
    """Numeric view of a sample; booleans are 1 and 0, blobs null."""
    return F.coalesce(F.col("v_f64"), F.col("v_f32").cast("double"), F.col("v_i64").cast("double"), F.col("v_u64").cast("double"), F.col("v_bool").cast("int").cast("double"))


def state_code() -> Column:
    """Code of a state sample: unsigned as it is, signed if not negative, boolean as 0 or 1."""
    return F.coalesce(F.col("v_u64").cast("bigint"), F.when(F.col("v_i64") >= 0, F.col("v_i64")), F.col("v_bool").cast("int").cast("bigint"))


def utc_us(anchor_ms: Column, init_us: Column, at_us: Column) -> Column:
    """Anchored time in microseconds; null without anchor or on overflow."""
    return F.try_add(F.try_add(F.try_multiply(anchor_ms.cast("bigint"), F.lit(1000).cast("bigint")), init_us.cast("bigint")), at_us.cast("bigint"))


def relative_us(utc: Column, anchor_ms: Column, init_us: Column) -> Column:
    """Run-relative time of an anchored instant; null before the run's start or without anchor."""
    out = F.try_subtract(F.try_subtract(utc, F.try_multiply(anchor_ms.cast("bigint"), F.lit(1000).cast("bigint"))), init_us.cast("bigint"))
    return F.when(out >= 0, out)


def just_before(at_us: Column) -> Column:
    return F.greatest(at_us - 1, F.lit(0))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(MAX_US)))


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.greatest(F.try_subtract(a, b), F.lit(0))


def saturating_multiply(a: Column, b: Column) -> Column:
    """Product of two that aren't negative."""
    return F.coalesce(F.try_multiply(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(MAX_US)))


def boot_time(boot: Column, at_us: Column) -> Column:
    """#3 01:02:03.456_789"""
    at = lambda unit: F.call_function("div", at_us, F.lit(unit).cast("bigint"))
    return F.format_string("#%d %02d:%02d:%02d.%03d_%03d", boot, at(3_600_000_000), at(60_000_000) % 60, at(1_000_000) % 60, at(1000) % 1000, at_us % 1000)


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("bigint")))


_SEGMENT = r"^([0-9a-f]{8})-([0-9a-f]{16})\.seg$"


def segment_name(boot: Column, base_us: Column) -> Column:
    return F.format_string("%08x-%016x.seg", boot, base_us)


def segment_boot(name: Column) -> Column:
    """Run of a segment name; null unless the name is one (lower-case hexadecimal, fixed widths)."""
    return F.when(name.rlike(_SEGMENT), F.conv(F.regexp_extract(name, _SEGMENT, 1), 16, 10).cast("bigint"))


def segment_base(name: Column) -> Column:
    return F.when(name.rlike(_SEGMENT), F.conv(F.regexp_extract(name, _SEGMENT, 2), 16, 10).cast("decimal(20,0)"))


def uuid_bytes(text: Column) -> Column:
    """16 bytes of a uuid, with or without hyphens; null if it isn't one."""
    digits = F.replace(text, F.lit("-"), F.lit(""))
    return F.when(digits.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(digits))


def plausible_utc(ms: Column) -> Column:
    return (ms >= F.lit(1_000_000_000_000)) & (ms < F.lit(4_102_444_800_000))


def valid_component(name: Column) -> Column:
    """Whether a name can be a path component: 1 to 64 bytes of [A-Za-z0-9._-], no leading dot, none of the reserved endings."""
    return name.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}$") & ~name.rlike(r"\.(tmp|seg|corrupt)$")


def segment_size(budget: Column) -> Column:
    """Segment size of a channel: a 256th of its budget, between 4 and 256 MiB."""
    return F.least(F.greatest(F.floor(budget / 256), F.lit(4 << 20)), F.lit(256 << 20)).cast("bigint")


def span_or_none(raw: Column) -> Column:
    return F.nullif(raw, F.lit(0))


def outside(v: Column, low: Column, high: Column) -> Column:
    """Whether a value leaves inclusive bounds, of which either may be null. NaN leaves any bounds."""
    return F.when(low.isNull() & high.isNull(), False).otherwise(F.isnan(v) | F.coalesce(v < low, F.lit(False)) | F.coalesce(v > high, F.lit(False)))
