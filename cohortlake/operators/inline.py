"""Aggregates of one customer's rows: sum, avg, min, max, count, dcount, test and row over rows that meet a condition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aggregate(kind: str, value: Column | None, where: Column, *, reverse: bool = False) -> Column:
    """An aggregate expression, for groupBy('id') or over a window. count and dcount of nothing are nil;
    avg of nothing is 0; min, max, row are nil, test false."""
    hit = F.coalesce(where, F.lit(False))
    if kind == "test":
        return F.max(hit)
    if kind == "row":
        return (F.max if reverse else F.min)(F.when(hit, F.col("rn")))
    v = F.when(hit, value)
    if kind == "count":
        return F.nullif(F.count(v), F.lit(0))
    if kind == "dcount":
        return F.nullif(F.count_distinct(v), F.lit(0))
    if kind == "avg":
        return F.coalesce(F.avg(v), F.lit(0.0))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](v)


def windowed(kind: str, value: Column | None, where: Column, window, *, reverse: bool = False) -> Column:
    """As aggregate(), over a window; distinct counts go by a set, which windows allow."""
    if kind == "dcount":
        return F.nullif(F.size(F.collect_set(F.when(F.coalesce(where, F.lit(False)), value)).over(window)), F.lit(0))
    hit = F.coalesce(where, F.lit(False))
    v = F.when(hit, value) if value is not None else None
    if kind == "test":
        return F.max(hit).over(window)
    if kind == "row":
        return (F.max if reverse else F.min)(F.when(hit, F.col("rn"))).over(window)
    if kind == "count":
        return F.nullif(F.count(v).over(window), F.lit(0))
    if kind == "avg":
        return F.coalesce(F.avg(v).over(window), F.lit(0.0))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](v).over(window)
