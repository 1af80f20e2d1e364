"""Scalar functions of scripts as Column expressions. Stamps are milliseconds since 1970, dates are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stamps below this are seconds.
SECONDS_BELOW = 4_102_444_800
SPANS_MS = {"ms": 1, "milliseconds": 1, "seconds": 1_000, "second": 1_000, "minutes": 60_000, "minute": 60_000, "hours": 3_600_000, "hour": 3_600_000, "days": 86_400_000, "day": 86_400_000, "weeks": 604_800_000, "week": 604_800_000, "months": 31 * 86_400_000, "month": 31 * 86_400_000, "years": 365 * 86_400_000, "year": 365 * 86_400_000}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def millis(x: Column) -> Column:
    return F.when(x < SECONDS_BELOW, x * 1000).otherwise(x)


def moment(stamp: Column) -> Column:
    """The stamp as a timestamp; the session's time zone must be UTC for the date parts."""
    return F.timestamp_millis(millis(stamp.cast("long")))


def _stamp(ts: Column) -> Column:
    return F.unix_millis(ts)


# numbers


def divide(a: Column, b: Column, integral: bool) -> Column:
    """0 where b is 0; whole numbers divide towards zero."""
    if integral:
        return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0))))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def bucket(v: Column, size: float) -> Column:
    """v cut towards zero to a multiple of size, to two decimals; 0 for size 0."""
    whole = int(size * 100)
    if not whole:
        return F.lit(0).cast("long")
    steps = F.call_function("div", (v * 100).cast("long"), F.lit(whole))
    return steps * F.lit(float(size)) if size < 1 else (steps * int(size)).cast("long")


def round_(v: Column, places: int = 0) -> Column:
    """Half away from zero."""
    return F.round(v, places)


def trunc(v: Column) -> Column:
    return v.cast("long")


def fix(v: Column, places: int) -> Column:
    """Text with exactly so many decimals, ten at most."""
    return F.round(v.cast("decimal(38,12)"), min(max(places, 0), 10)).cast("string")


def to_int(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(v.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def to_float(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(v.cast("string"), r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


# dates


def to_span(unit: str, v: Column) -> Column:
    return F.call_function("div", v.cast("long"), F.lit(SPANS_MS[unit]))


def date_part(part: str, stamp: Column) -> Column:
    t = moment(stamp)
    made = {"second": F.second, "minute": F.minute, "hour": F.hour, "day_of_week": F.dayofweek, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "month": F.month, "quarter": F.quarter, "year": F.year}
    return made[part](t).cast("long")


def start_of(unit: str, stamp: Column) -> Column:
    """Weeks begin on Sundays."""
    t = moment(stamp)
    if unit == "week":
        return _stamp(F.date_trunc("week", t + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY"))
    return _stamp(F.date_trunc(unit, t))


def iso8601_to_stamp(s: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(s))


def iso8601(stamp: Column) -> Column:
    return F.date_format(moment(stamp), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# strings and URLs


def remove(s: Column, part: Column) -> Column:
    return F.replace(s, part, F.lit(""))


def find(s: Column, needle: Column, start: int = 0) -> Column:
    return F.call_function("locate", needle, s, F.lit(start + 1)).cast("long") - 1


def rfind(s: Column, needle: Column) -> Column:
    back = F.locate if isinstance(needle, str) else lambda n, x: F.call_function("locate", n, x)
    at = back(F.reverse(needle), F.reverse(s))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(s) - F.length(needle) - at + 1).cast("long")


def slice_text(s: Column, a: int | None, b: int | None) -> Column:
    """s[a:b] with Python's negative indexes."""
    n = F.length(s)
    lo = F.lit(0) if a is None else (F.greatest(n + a, F.lit(0)) if a < 0 else F.least(F.lit(a), n))
    hi = n if b is None else (F.greatest(n + b, F.lit(0)) if b < 0 else F.least(F.lit(b), n))
    return F.when(hi > lo, F.substring(s, lo + 1, hi - lo)).otherwise(F.lit(""))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def split(s: Column, separator: Column) -> Column:
    """Cut at each occurrence of the text separator."""
    return F.split(s, F.concat(F.lit("\\Q"), separator, F.lit("\\E")))


def url_decode(url: Column) -> Column:
    """host, path, query and params (a map; 'true' for a parameter without a value)."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    params = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.try_url_decode(F.split_part(x, F.lit("="), F.lit(1))), F.when(x.contains("="), F.try_url_decode(F.regexp_extract(x, "=(.*)$", 1))).otherwise("true"))))
    return F.struct(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("host"), F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"), query.alias("query"), params.alias("params"))


# containers


def list_minus(xs: Column, gone: Column) -> Column:
    """Keeps repeated elements."""
    return F.filter(xs, lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False)))


def at(xs: Column, index: Column) -> Column:
    """0-based; nil outside, also for negative indexes."""
    return F.when(index >= 0, F.get(xs, index.cast("int")))
