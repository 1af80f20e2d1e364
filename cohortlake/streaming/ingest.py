"""Continuous ingestion: JSON events in micro-batches, coerced by the batch rules and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cohortlake.sources import events as source
from cohortlake.spec import TableSpec


def read_stream(spark: SparkSession, path: str, spec: TableSpec, *, files_per_batch: int | None = None) -> DataFrame:
    """Events of new line-delimited JSON files under path; the schema comes from the specification."""
    reader = spark.readStream.schema(source.json_schema(spec))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return source.coerce(reader.json(path), spec)


def into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each batch, with arrival numbers, to sink(events, batch id).

    A batch may come again after a failure (at least once); sinks that overwrite by batch id make it once.
    """

    def apply(batch: DataFrame, n: int) -> None:
        sink(batch.withColumn("seq", F.lit(n << 33) + F.monotonically_increasing_id()), n)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch, overwritten if the batch comes again."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def stored(spark: SparkSession, path: str, spec: TableSpec, *, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, customers) of all batches: deduplicated, ordered, within the retention limits."""
    return source.ingest(spark.read.parquet(path).drop("batch"), spec, seq="seq", now=now)


def sessions(stream: DataFrame, gap_ms: int, *, lateness: str = "1 day") -> DataFrame:
    """(id, first_stamp, last_stamp, n) of closed sessions; a gap of exactly gap_ms does not close one.

    The watermark only bounds the state; ingestion itself drops nothing as late.
    """
    timed = stream.withColumn("at", F.timestamp_millis("stamp")).withWatermark("at", lateness)
    # a session window ends gap after its last event, exclusive; one more millisecond makes it inclusive
    w = F.session_window("at", f"{gap_ms + 1} milliseconds")
    return timed.groupBy("id", w).agg(F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"), F.count("*").alias("n")).drop("session_window")
