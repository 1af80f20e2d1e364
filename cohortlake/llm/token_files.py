"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A shard has three files: part-N.bin (ids, little-endian unsigned 16 or 32 bits), part-N.idx (signed
64-bit offsets: where each document begins in the shard, and its end) and part-N.doc (signed 64-bit
document ids). Shards are ranges of ascending ids. manifest.json names the shards and holds each
one's base, the prefix sum of the shards before it: base + offset is a document's place in the whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm import text as X
from cohortlake.llm.shared import partitions, ship
from cohortlake.llm.tokens import encoder

_SHARD = T.StructType([T.StructField("shard", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("n_docs", "n_tokens", "n_null_ids")]])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _map(path: str, kind: np.dtype) -> np.ndarray:
    """The file as an array: mapped where it is a local one, else read."""
    fs, name = _open(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype=kind, mode="r") if fs.get_file_info(name).size else np.zeros(0, kind)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype=kind)


@dataclass
class TokenFiles:
    """A written set of shards; document(i) is the i-th in ascending order of ids."""

    path: str
    dtype: str
    shards: list[dict]

    @classmethod
    def load(cls, path: str) -> TokenFiles:
        fs, name = _open(f"{path}/manifest.json")
        with fs.open_input_file(name) as f:
            return cls(path=path, **json.loads(f.read()))

    def save(self) -> None:
        fs, name = _open(f"{self.path}/manifest.json")
        with fs.open_output_stream(name) as f:
            f.write(json.dumps({k: v for k, v in asdict(self).items() if k != "path"}, indent=1).encode())

    def arrays(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets and document ids of shard k."""
        stem = f"{self.path}/part-{self.shards[k]['shard']:05d}"
        return _map(f"{stem}.bin", np.dtype(self.dtype)), _map(f"{stem}.idx", np.dtype("<i8")), _map(f"{stem}.doc", np.dtype("<i8"))

    def __len__(self) -> int:
        return sum(s["n_docs"] for s in self.shards)

    def document(self, i: int) -> np.ndarray:
        for k, s in enumerate(self.shards):
            if i < s["n_docs"]:
                ids, offsets, _ = self.arrays(k)
                return ids[offsets[i] : offsets[i + 1]]
            i -= s["n_docs"]
        raise IndexError(i)


def _write(path: str, file: str, spaced: bool, end: int, text: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = _open(path)
        names = {x: f"{root}/part-{shard:05d}.{x}" for x in ("bin", "idx", "doc")}
        held = {x: f"{root}/.part-{shard:05d}.{x}.{attempt}" for x in names}
        e = encoder(file, spaced)
        counts, docs, nulls = [], [], 0
        with fs.open_output_stream(held["bin"]) as out:
            for batch in batches:
                for part in X.portions(batch, text):
                    ids, n = e.encode_ended(part.column(text), end)
                    out.write(np.ascontiguousarray(ids.astype(dtype)))
                    counts.append(n)
                    nulls += part.column("doc_id").null_count
                    docs.append(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        total = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))]).astype("<i8")
        for x, values in (("idx", total), ("doc", np.concatenate([*docs, np.zeros(0, "<i8")]))):
            with fs.open_output_stream(held[x]) as out:
                out.write(np.ascontiguousarray(values))
        for x in names:
            fs.move(held[x], names[x])  # an attempt's files appear whole; another attempt writes the same bytes
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([v], pa.int64()) for v in (len(total) - 1, int(total[-1]), nulls)]], names=_SHARD.names)

    return run


def write_token_files(docs: DataFrame, path: str, *, file: str, spaced: bool = True, end: int = 0, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> TokenFiles:
    """Encodes every text, appends the id `end` and writes the shards under path (a folder all share).

    Null texts are empty: one id. Rows without an id come first, those of one id in the order of a hash
    of their texts. An empty table gives shards without documents.
    """
    ship(docs.sparkSession)
    dtype = np.dtype(encoder(file, spaced).kind).newbyteorder("<").str
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(shards or partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    made = sorted((r.asDict() for r in dealt.mapInArrow(_write(path, file, spaced, end, "text", dtype), _SHARD).collect()), key=lambda r: r["shard"])
    bases = [0, *accumulate(r["n_tokens"] for r in made)]
    out = TokenFiles(path, dtype, [{**r, "base": b} for r, b in zip(made, bases, strict=False)])
    out.save()
    return out


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TokenFiles.load(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, offsets, docs = files.arrays(k)
                for a in range(0, len(docs), 1000):
                    b = min(a + 1000, len(docs))
                    own = np.ascontiguousarray(ids[offsets[a] : offsets[b]])
                    null = np.arange(a, b) < files.shards[k]["n_null_ids"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a:b], mask=null), pa.array(offsets[a:b] + files.shards[k]["base"]), X.binaries(own.astype("<u4"), np.diff(offsets[a : b + 1]))],
                        names=["doc_id", "start", "ids"],
                    )

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document, one task per shard; ids are little-endian unsigned 32-bit."""
    ship(spark)
    n = len(TokenFiles.load(path).shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(_read(path), "doc_id long, start long, ids binary")


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
