"""Packing by minimum bin slack, over lengths rather than documents.

Documents are cut into full windows and a rest. Rests of one length are alike, so the driver packs a
table of at most `capacity` lengths and counts: it fixes the longest rest, fills what is left of the
window by a bitset subset-sum over the remaining multiset, backtracks to the counts of each length, and
uses that filling as often as they allow. Each piece then finds its place from its rank among the
pieces of its length, which comes from prefix sums over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlake.llm import text as X
from cohortlake.llm.shared import saved, ship, spread
from cohortlake.llm.tokens import encoder

CAPACITY = 2048
#: The prefix sums (partitions times lengths) are broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass
class Filling:
    """`times` sequences, each with counts[i] pieces of lengths[i]."""

    lengths: list[int]
    counts: list[int]
    times: int


def fill(room: int, left: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to room as it can be.

    Bit s of `reached` says that some multiset of the lengths so far sums to s. Copies of a length are
    added in powers of two, so a length costs a few shifts however many pieces have it.
    """
    reached, whole = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for size in sorted((x for x in left if x <= room), reverse=True):
        copies, block = min(left[size], room // size), 1
        while copies > 0 and not reached >> room & 1:
            take = min(block, copies)
            steps.append((size, take, reached))
            reached |= reached << (size * take) & whole
            copies -= take
            block *= 2
        if reached >> room & 1:
            break
    goal, taken = reached.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> goal & 1:
            taken[size] = taken.get(size, 0) + take
            goal -= size * take
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Fillings that use up exactly `counts` pieces of each length."""
    left = {x: n for x, n in counts.items() if n > 0}
    out: list[Filling] = []
    while left:
        longest = max(left)
        left[longest] -= 1
        if not left[longest]:
            del left[longest]
        taken = fill(capacity - longest, left)
        left[longest] = left.get(longest, 0) + 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // n for x, n in taken.items())
        sizes = sorted(taken, reverse=True)
        out.append(Filling(sizes, [taken[x] for x in sizes], times))
        for x, n in taken.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def _cut(file: str, spaced: bool, end: int, text: str, doc_id: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part_id = encoder(file, spaced), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in X.portions(batch, text):
                ids, n = e.encode_ended(part.column(text), end)
                per = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), per)
                start = X.spans(np.zeros(len(n), np.int64), per) * capacity
                length = np.minimum(n[doc] - start, capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.searchsorted(ranked, ranked)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - first + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(np.full(len(doc), part_id, np.int32)), pa.array(rank), X.binaries(ids, length)],
                    names=["doc_id", "start", "length", "doc_tokens", "part", "rank", "ids"],
                )

    return run


def _place(fillings: list[Filling], kind: np.dtype):
    """Sequence and offset of each piece from its length and its rank among the pieces of its length."""
    keys, bases, counts, firsts, sizes = [], [], [], [], []
    used: dict[int, int] = {}
    sequences = 0
    for f in fillings:
        offset = 0
        for size, n in zip(f.lengths, f.counts, strict=True):
            keys.append((size << 48) + used.get(size, 0))
            bases.append(sequences)
            counts.append(n)
            firsts.append(offset)
            sizes.append(used.get(size, 0))
            used[size] = used.get(size, 0) + n * f.times
            offset += size * n
        sequences += f.times
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, int)
    keys, bases, counts, firsts, before = (np.array(a, np.int64)[order] for a in (keys, bases, counts, firsts, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            row = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            own = rank - before[row]
            sequence, slot = bases[row] + own // counts[row], own % counts[row]
            raw = X.texts(batch.column("ids").cast(pa.large_binary()).view(pa.large_string()))
            ids = np.ascontiguousarray(raw.data).view(kind).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("length"), X.binaries(ids, length), batch.column("doc_tokens"), pa.array(sequence), pa.array(firsts[row] + slot * length)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, *, file: str, spaced: bool = False, end: int = 1, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of sequences of up to capacity ids.

    Each text's ids and the id `end` are cut at multiples of capacity; each piece lies in one sequence, at
    offset. ids are little-endian unsigned 32-bit. Null texts are empty: one id. Rows are handled one by
    one, so repeated rows and ids, null ids and other columns change nothing; an empty table has no pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    fields = [docs.schema[doc_id].dataType, T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(("doc_id", "start", "length", "doc_tokens", "part", "rank", "ids"), fields, strict=True)])
    cut = saved(spread(docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text))).mapInArrow(_cut(file, spaced, end, text, doc_id, capacity), schema), "pieces")
    here = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part")
    before = saved(here.withColumn("before", F.sum("n").over(order) - F.col("n")), "piece-ranks")
    # at most `capacity` rows
    totals = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bases = before.select("part", "length", "before")
    placed = cut.join(F.broadcast(bases) if before.count() <= BROADCAST_ROWS else bases, ["part", "length"])
    out = T.StructType([schema["doc_id"], schema["start"], schema["length"], schema["ids"], schema["doc_tokens"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.select("doc_id", "start", "length", "rank", "before", "doc_tokens", "ids").mapInArrow(_place(plan(totals, capacity), encoder(file, spaced).kind), out)
