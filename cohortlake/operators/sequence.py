"""Sequence joins inside a customer: all later matches, the next or previous one, matches within a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlake.operators.rows import ordered


def then(first: DataFrame, second: DataFrame, *, span: int | None = None, inclusive: bool = False, ahead: bool = True, back: bool = False, prefix: str = "b_") -> DataFrame:
    """Pairs of a row of `first` with the rows of `second` of the same customer after it (ahead) or before it (back).

    Both are numbered frames. span: at most so many milliseconds apart. Columns of second get the prefix.
    An equi-join on id with a range condition: one shuffle, none if both come from one frame by id. The
    result has a row per matching pair; where only the nearest is asked for, nearest() has one per row.
    """
    other = second.select(*[F.col(c).alias("id" if c == "id" else f"{prefix}{c}") for c in second.columns])
    after, before = F.col(f"{prefix}rn") > F.col("rn"), F.col(f"{prefix}rn") < F.col("rn")
    if inclusive:
        after, before = F.col(f"{prefix}rn") >= F.col("rn"), F.col(f"{prefix}rn") <= F.col("rn")
    where = (after | before) if ahead and back else after if ahead else before
    if span is not None:
        lo = F.col("stamp") - span if back else F.col("stamp")
        hi = F.col("stamp") + span if ahead else F.col("stamp")
        where = where & F.col(f"{prefix}stamp").between(lo, hi)
    return first.join(other, "id").where(where)


def nearest(events: DataFrame, condition: Column, columns: list[str], *, back: bool = False, prefix: str = "next_") -> DataFrame:
    """On every row the given columns of the next row (the previous one if back) that meets the condition.

    One window over the order of the frame, so it costs a sort, not a join.
    """
    w = ordered()
    found = F.when(condition, F.struct(*columns))
    if back:
        match = F.last(found, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    else:
        match = F.first(found, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = events.withColumn("_match", match)
    return out.select(*events.columns, *[F.col(f"_match.{c}").alias(f"{prefix}{c}") for c in columns])


def count_within(events: DataFrame, condition: Column, before_ms: int, after_ms: int, name: str) -> DataFrame:
    """How many rows that meet the condition lie within the span around each row, itself included."""
    w = Window.partitionBy("id").orderBy("stamp").rangeBetween(-before_ms, after_ms)
    return events.withColumn(name, F.count(F.when(condition, F.lit(1))).over(w))


def next_baskets(events: DataFrame, *, head: str, item: str, basket: str, product: str) -> DataFrame:
    """(id, rn, item columns, product_before): each item of a basket with each product of the basket before it.

    A customer's baskets are numbered in the order of their heads; pairs of neighbouring baskets then meet by
    equality on (id, basket number), so a customer's history is never joined with itself as a whole.
    """
    heads = events.where(F.col("event") == head).select("id", basket, F.row_number().over(ordered()).alias("n_basket"))
    items = events.where(F.col("event") == item).join(heads, ["id", basket])
    before = items.select("id", (F.col("n_basket") + 1).alias("n_basket"), F.col(product).alias("product_before")).distinct()
    return items.join(before, ["id", "n_basket"]).where(F.col(product) != F.col("product_before"))
