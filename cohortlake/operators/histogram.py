"""Histograms of one number per customer, with zero fill, and distributions of a property's values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers are bucketed as whole ten-thousandths.
SCALE = 10_000


def bucket_of(v: Column, size: float) -> Column:
    """v cut towards zero to a multiple of size."""
    b = int(round(size * SCALE))
    return F.call_function("div", F.round(v * SCALE, 0).cast("long"), F.lit(b)) * F.lit(b) / SCALE


def histogram(values: DataFrame, *, bucket: float | None = None, low: float | None = None, high: float | None = None, by: list[str] | None = None) -> DataFrame:
    """(by.., bucket, customers) of values (id, value, by..); rows without a value are skipped.

    Without a bucket size values stand as they are. With one, missing buckets between the smallest (or low)
    and the largest (or high) are 0, and values of high or more are in one bucket, high, always present.
    """
    by = by or []
    had = values.where(F.col("value").isNotNull())
    if not bucket:
        return had.groupBy(*by, F.col("value").cast("double").alias("bucket")).agg(F.count_distinct("id").alias("customers"))
    at = bucket_of(F.col("value").cast("double"), bucket)
    if high is not None:
        at = F.least(at, F.lit(float(high)))
    counted = had.groupBy(*by, at.alias("bucket")).agg(F.count_distinct("id").alias("customers"))
    step = int(round(bucket * SCALE))
    scaled = F.round(F.col("bucket") * SCALE, 0).cast("long")
    lo = F.min(scaled) if low is None else F.lit(int(low * SCALE) // step * step)
    hi = F.max(scaled) if high is None else F.lit(int(high * SCALE))
    bounds = counted.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi")) if by else counted.agg(lo.alias("lo"), hi.alias("hi"))
    steps = F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi", F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    filled = bounds.where("lo IS NOT NULL").select(*by, F.explode(F.array_distinct(F.concat(steps, F.array("hi")) if high is not None else steps)).alias("b"))
    filled = filled.select(*by, (F.col("b") / SCALE).alias("bucket"), F.lit(0).cast("long").alias("customers"))
    return counted.unionByName(filled).groupBy(*by, "bucket").agg(F.sum("customers").alias("customers"))


def foreach(events: DataFrame, prop: str, value: Column, **options) -> DataFrame:
    """A histogram per value of prop: `value` aggregates the customer's rows of that value."""
    per = events.where(F.col(prop).isNotNull()).groupBy("id", F.col(prop).alias("each_value")).agg(value.alias("value"))
    return histogram(per, by=["each_value"], **options)


def property_filter(prop: str, *, gt=None, gte=None, lt=None, lte=None, eq=None, between: tuple | None = None, rx: str | None = None, sub: str | None = None) -> Column:
    """The first of the filters that is given; between includes its low end only; rx matches whole values."""
    c = F.col(prop)
    for given, made in ((gt, lambda: c > gt), (gte, lambda: c >= gte), (lt, lambda: c < lt), (lte, lambda: c <= lte), (eq, lambda: c == eq), (between, lambda: (c >= between[0]) & (c < between[1])), (rx, lambda: c.rlike(f"^(?:{rx})$")), (sub, lambda: c.contains(sub))):
        if given is not None:
            return made()
    return F.lit(True)


def property_values(events: DataFrame, prop: str, *, bucket: float | None = None, members: DataFrame | None = None, is_set: bool = False, **filters) -> DataFrame:
    """(value, customers): distinct customers per value of a property, or per bucket of values; the row with
    a null value counts all customers that have the property."""
    if rx := filters.get("rx"):
        re.compile(rx)
    rows = events.select("id", (F.explode(prop) if is_set else F.col(prop)).alias(prop)).where(F.col(prop).isNotNull())
    if members is not None:
        rows = rows.join(members.select("id").distinct(), "id", "left_semi")
    kept = rows.where(property_filter(prop, **filters))
    value = bucket_of(F.col(prop).cast("double"), bucket) if bucket else F.col(prop)
    both = kept.select("id", value.alias("value")).unionByName(rows.select("id", F.lit(None).cast(kept.select(value.alias("v")).schema["v"].dataType).alias("value")))
    return both.groupBy("value").agg(F.count_distinct("id").alias("customers"))
