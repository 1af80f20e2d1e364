"""Session settings the engine counts on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """UTC dates, adaptive plans, and this package on the path of Python workers of one machine."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    return spark
