"""Where tables that outlive a plan are kept: written once, read back, so plans stay short and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlake.errors import ConfigError


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and all runs on one machine, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share", "no_shared_folder")
    base = f"file://{tempfile.mkdtemp(prefix='cohortlake-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own, whatever plan it came from."""
    path = f"{folder(df.sparkSession)}/engine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
