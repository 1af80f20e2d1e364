"""Segments: named sets of customers as rows (segment, id), their algebra, refresh and changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class SegmentSpec:
    """refresh and ttl in milliseconds; larger z_index is evaluated later."""

    name: str
    script: str
    refresh: int = 300_000
    ttl: int = 0
    use_cached: bool = False
    on_insert: bool = False
    z_index: int = 100
    refreshed_at: int = 0

    def due(self, now: int) -> bool:
        return now >= self.refreshed_at + self.refresh


def in_order(specs: list[SegmentSpec]) -> list[SegmentSpec]:
    return sorted(specs, key=lambda s: (s.z_index, s.name))


def members(per_customer: DataFrame, name: str, condition) -> DataFrame:
    """(segment, id) of the customers that meet the condition."""
    return per_customer.where(F.coalesce(condition, F.lit(False))).select(F.lit(name).alias("segment"), "id").distinct()


def _ids(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("segment") == name).select("id")


def population(table: DataFrame, a: str) -> DataFrame:
    return _ids(table, a).distinct()


def union(table: DataFrame, *names: str) -> DataFrame:
    return table.where(F.col("segment").isin(*names)).select("id").distinct()


def intersection(table: DataFrame, *names: str) -> DataFrame:
    """One aggregation for any number of segments."""
    rows = table.where(F.col("segment").isin(*names)).groupBy("id").agg(F.count_distinct("segment").alias("n"))
    return rows.where(F.col("n") == len(set(names))).select("id")


def difference(table: DataFrame, a: str, *others: str) -> DataFrame:
    rows = table.where(F.col("segment").isin(a, *others)).groupBy("id").agg(F.max(F.col("segment") == a).alias("own"), F.max(F.col("segment").isin(*others)).alias("other"))
    return rows.where("own AND NOT other").select("id")


def complement(everyone: DataFrame, table: DataFrame, a: str) -> DataFrame:
    return everyone.select("id").distinct().join(_ids(table, a), "id", "left_anti")


def restrict(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """rows of customers in any of the segments; '*' is everyone."""
    return rows if "*" in names else rows.join(union(table, *names), "id", "left_semi")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(segment, id, state): 'enter' where a membership is new, 'exit' where it is gone."""
    old = before.select("segment", "id", F.lit(1).alias("old")).distinct()
    new = after.select("segment", "id", F.lit(1).alias("new")).distinct()
    return old.join(new, ["segment", "id"], "full_outer").where("old IS NULL OR new IS NULL").select("segment", "id", F.when(F.col("old").isNull(), "enter").otherwise("exit").alias("state"))


def counts(table: DataFrame) -> DataFrame:
    return table.groupBy("segment").agg(F.count_distinct("id").alias("customers"))
