"""Where jobs keep what outlives a stage, and how executors find this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package; a cluster gets it by --py-files or an image."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and all runs on one machine, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='cohortlake-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that were made inside; results must be written before it ends."""
    before = len(_made)
    yield
    for path in _made[before:]:
        discard(spark, path)
    del _made[before:]


def writer(df: DataFrame, path: str) -> DataFrameWriter:
    """For intermediate tables. On a mounted folder each file would cost two chmod processes of the executor, one
    for its checksum file; without checksum files it is one. Other file systems are written as ever."""
    if not path.startswith("file:"):
        return df.write
    return df.write.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, so lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    writer(df, path).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def most_frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest counts n: as many whole steps of a sixteenth of an octave as `most` rows hold.

    A histogram of about a thousand steps gives the smallest count to keep, so no task sorts or receives
    the candidates of all others, as it would for a limit after an order.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    sizes = sorted(((r["step"], r["rows"]) for r in df.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for k, rows in sizes:
        if total + rows > most:
            break
        least, total = k, total + rows
    return df.limit(0) if least is None else df.where(step >= least)


#: A key with fewer rows is never split.
LEAST_SPLIT = 100


def hot_keys(counts: DataFrame, on: list[str], total: int) -> DataFrame | None:
    """(on.., parts) of the keys whose n rows are more than half a partition's share of the total, None if
    there are none. At most two keys a partition can be, whatever the data: small enough to send along."""
    spark = counts.sparkSession
    limit = max(LEAST_SPLIT, total // (2 * partitions(spark)))
    rows = counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    found = rows.collect()
    return spark.createDataFrame(found, rows.schema) if found else None


def salted_join(left: DataFrame, right: DataFrame, on: dict[str, str], hot: DataFrame | None, by: list[str]) -> DataFrame:
    """left joined to the rows of right with the same keys (on: left's name to right's; nulls are equal).

    hot has the keys of which left has many rows: these are dealt to `parts` salts by a hash of the columns
    `by`, and right's row of the key is there once for each. Keys of right are dropped.
    """
    match = [left[a].eqNullSafe(right[b]) for a, b in on.items()]
    if hot is not None:
        few = hot.toDF(*[f" {c}" for c in hot.columns])
        keys = list(zip(on.items(), few.columns, strict=False))

        def parted(df: DataFrame, names: list[str]) -> DataFrame:
            same = F.lit(True)
            for n, (_, k) in zip(names, keys, strict=True):
                same = same & df[n].eqNullSafe(few[k])
            return df.join(F.broadcast(few), same, "left").drop(*[k for _, k in keys]).withColumn(" parts", F.coalesce(" parts", F.lit(1)))

        left = parted(left, list(on)).withColumn(" salt", F.pmod(F.xxhash64(*by), F.col(" parts")).cast("int")).drop(" parts")
        right = parted(right, list(on.values())).withColumn(" other", F.explode(F.sequence(F.lit(0), F.col(" parts") - 1))).drop(" parts")
        match = [left[a].eqNullSafe(right[b]) for a, b in on.items()] + [left[" salt"] == right[" other"]]
    out = left
    where = match[0]
    for m in match[1:]:
        where = where & m
    return out.join(right, where).drop(*[right[b] for b in on.values()]).drop(" salt", " other")


def spread(df: DataFrame) -> DataFrame:
    """A table too small to be cut into a task for each core is dealt out before work on its texts; others are read as
    they lie. Only where the work is done changes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(cores) if size < cores * (4 << 20) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
