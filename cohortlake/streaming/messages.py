"""Subscriptions to segment changes, delivered at least once in bounded batches.

With a MessageLog messages lie on shared storage before their batch is committed, and so do the subscribers'
positions: a new driver goes on where the last one stopped. Without one they wait in the driver's memory.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.errors import ConfigError
from cohortlake.functions.scalars import SPANS_MS

BATCH = 500
BACK_OFF_MS, MOST_BACK_OFF_MS = 250, 300_000


@dataclass
class Subscription:
    """send takes a list of messages and returns whether they were taken."""

    segment: str
    name: str
    send: Callable[[list[dict]], bool]
    retention: int = 3 * SPANS_MS["hours"]
    waiting: list[dict] = field(default_factory=list)
    failures: int = 0
    not_before: int = 0


class MessageLog:
    """Messages as Parquet, a folder per batch; a position is the name of an empty file, so it is written whole or not."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def append(self, batch: DataFrame, n: int) -> None:
        """A batch that comes again replaces itself."""
        batch.withColumn("seq", F.lit(n << 33) + F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/log/batch={n}")

    def after(self, segment: str, seq: int, since: int) -> DataFrame | None:
        fs, where = self._at("log")
        if not fs.exists(where):
            return None
        rows = self.spark.read.parquet(f"{self.path}/log").drop("batch")
        return rows.where((F.col("segment") == segment) & (F.col("seq") > seq) & (F.col("stamp") > since)).orderBy("seq")

    def position(self, segment: str, name: str) -> int:
        fs, where = self._at(f"positions/{segment}~{name}")
        return max((int(f.getPath().getName()) for f in fs.listStatus(where)), default=-1) if fs.exists(where) else -1

    def advance(self, segment: str, name: str, seq: int) -> None:
        before = self.position(segment, name)
        fs, where = self._at(f"positions/{segment}~{name}/{seq}")
        fs.create(where, True).close()
        if before >= 0 and before != seq:
            fs.delete(self._at(f"positions/{segment}~{name}/{before}")[1], False)


class Broker:
    def __init__(self, segments: set[str] | None = None, log: MessageLog | None = None):
        self.segments, self.subscriptions, self.log = segments, {}, log

    def subscribe(self, s: Subscription) -> None:
        """The segment must exist, and the receiver must take an empty batch first."""
        if self.segments is not None and s.segment not in self.segments:
            raise ConfigError(f"no segment {s.segment}", "segment_missing")
        if not s.send([]):
            raise ConfigError(f"{s.name} does not answer", "subscriber_unreachable")
        self.subscriptions[s.segment, s.name] = s

    def unsubscribe(self, segment: str, name: str) -> None:
        if self.subscriptions.pop((segment, name), None) is None:
            raise ConfigError(f"no subscription {name} to {segment}", "subscription_missing")

    def push(self, messages: list[dict], now: int) -> None:
        for s in self.subscriptions.values():
            s.waiting = [m for m in s.waiting if m["stamp"] > now - s.retention] + [m for m in messages if m["segment"] == s.segment]

    def deliver(self, now: int) -> int:
        """Sends what waits; a batch stays until it is taken. Waits grow by steps of the failures so far."""
        sent = 0
        for s in self.subscriptions.values():
            if self.log is not None:
                sent += self.deliver_logged(s, now)
            while s.waiting and now >= s.not_before:
                if s.send(s.waiting[:BATCH]):
                    sent += len(s.waiting[:BATCH])
                    s.waiting, s.failures = s.waiting[BATCH:], 0
                else:
                    s.failures += 1
                    s.not_before = now + min(BACK_OFF_MS * s.failures, MOST_BACK_OFF_MS)
        return sent

    def deliver_logged(self, s: Subscription, now: int) -> int:
        """From the log, behind the subscriber's position; it moves when a batch is taken."""
        rows = self.log.after(s.segment, self.log.position(s.segment, s.name), now - s.retention) if now >= s.not_before else None
        sent, part, rest = 0, [], iter(rows.toLocalIterator()) if rows is not None else iter(())
        while True:
            part = [r.asDict() for _, r in zip(range(BATCH), rest, strict=False)]
            if not part:
                return sent
            if not s.send([{k: v for k, v in m.items() if k != "seq"} for m in part]):
                s.failures += 1
                s.not_before = now + min(BACK_OFF_MS * s.failures, MOST_BACK_OFF_MS)
                return sent
            self.log.advance(s.segment, s.name, part[-1]["seq"])
            sent, s.failures = sent + len(part), 0

    def batch_sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch on a stream of changes: rows come through an iterator, not in one piece. With a log they
        are written before the batch is committed."""

        def take(batch: DataFrame, n: int) -> None:
            now, part = int(time.time() * 1000), []
            if self.log is not None:
                self.log.append(batch, n)
            for r in batch.toLocalIterator() if self.log is None else ():
                part.append(r.asDict())
                if len(part) == BATCH:
                    self.push(part, now)
                    part = []
            self.push(part, now)
            self.deliver(now)

        return take
