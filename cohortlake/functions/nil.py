"""Comparison, logic and truth as scripts see them: nil is a value, never SQL's unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def unequal(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def ordered(op: str, a: Column, b: Column) -> Column:
    """< <= > >=; false if either side is nil. In this form the comparison still reaches the scan."""
    raw = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return a.isNotNull() & b.isNotNull() & raw


def both(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def truthy(x: Column, kind: T.DataType) -> Column:
    """0, nil, '' and empty containers are false."""
    if isinstance(kind, T.BooleanType):
        yes = x
    elif isinstance(kind, T.StringType):
        yes = x != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        yes = F.size(x) > 0
    elif isinstance(kind, T.NullType):
        return F.lit(False)
    else:
        yes = x != 0
    return F.coalesce(yes, F.lit(False))


def among(a: Column, values: list) -> Column:
    """a is one of plain values; false if it is nil."""
    return a.isNotNull() & a.isin(*values)


def contains(xs: Column, v: Column, many: bool) -> Column:
    """xs holds v, or all of v where v is a container."""
    yes = F.size(F.array_except(v, xs)) == 0 if many else F.array_contains(xs, v)
    return F.coalesce(yes, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
