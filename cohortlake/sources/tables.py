"""Stored event tables, bucketed and sorted by customer, so that queries by customer need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(events: DataFrame, name: str, buckets: int, *, mode: str = "overwrite") -> None:
    """A Parquet table bucketed by id and sorted by id, stamp, z and seq; choose buckets of about 128 MB."""
    events.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id", "stamp", "z", "seq").mode(mode).saveAsTable(name)


def load(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def ever_prefilter(events: DataFrame, condition) -> DataFrame:
    """Events of customers that meet the condition on some row. Worth it where few customers do: the
    condition reaches the scan, and later windows and sorts see those customers only."""
    return events.join(events.where(F.coalesce(condition, F.lit(False))).select("id").distinct(), "id", "left_semi")
