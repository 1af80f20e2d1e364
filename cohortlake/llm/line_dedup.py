"""Line dedup by winnowing: repeated runs of lines are found from few fingerprints and cut where they recur.

Lines with a word, in order, make up a document; a line equals another if its bytes from first to last
word do. A gram is the shortest run from a line on with at least GRAM_WORDS words. Each window (the
shortest run from a line on with WINDOW_WORDS words, or the whole of a shorter document) selects the
gram with the smallest hash inside it, the last one of equals. Equal runs of WINDOW_WORDS words thus select
equal grams, so each such repetition is found; grams have enough words to be repetitions by themselves.
Shorter repetitions may be left: short lines recur in clean texts too. With gram_words=1 and window_words=1
every line is a gram and is selected, so every later copy of any line goes, exactly.

Each later occurrence of a selected gram is laid against its first one in the corpus (by doc_id, text
hash, position), and the match extended line by line both ways; the later copy's lines go. Where a run goes
on past what the first copy shares, the rest goes if a gram of its own is selected there. The first
copy of any line never goes, since each deletion points to an earlier place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm import text as X
from cohortlake.llm.shared import hot_keys, salted_join, saved, ship, spread

GRAM_WORDS = 25
WINDOW_WORDS = 50


def _solid(t: X.Texts) -> tuple[X.Pieces, X.Pieces, np.ndarray, np.ndarray]:
    """All lines; those with a word, trimmed to their words; their words; their index in all lines."""
    lines, words = X.lines(t), X.pieces(t, X.SPACES)
    a, b = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    full = np.flatnonzero(b > a)
    before = np.concatenate([[0], np.cumsum(b > a)])
    solid = X.Pieces(words.starts[a[full]], words.ends[b[full] - 1], before[lines.lo], before[lines.hi])
    return lines, solid, (b - a)[full], full


def select(values: np.ndarray, ends: np.ndarray, windows: np.ndarray) -> list[int]:
    """Starts of the grams selected in one document. Gram i is [i, ends[i]), window i is [i, windows[i]);
    both ends ascend."""
    chosen: list[int] = []
    queue: deque[int] = deque()
    at = 0
    for i, stop in enumerate(windows):
        while at < len(ends) and ends[at] <= stop:
            while queue and values[queue[-1]] >= values[at]:
                queue.pop()
            queue.append(at)
            at += 1
        while queue and queue[0] < i:
            queue.popleft()
        if queue and (not chosen or chosen[-1] != queue[0]):
            chosen.append(queue[0])
    return chosen


def _fingerprints(text: str, gram_words: int, window_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.portions(batch, text):
                t = X.texts(part.column(text))
                _, solid, n_words, _ = _solid(t)
                h = X.hashes(t.data, solid.starts, solid.ends)
                total = np.concatenate([[0], np.cumsum(n_words)])
                gram_end = np.searchsorted(total, total[:-1] + gram_words)
                window_end = np.searchsorted(total, total[:-1] + window_words)
                position, key, per = [], [], []
                for lo, hi in zip(solid.lo.tolist(), solid.hi.tolist(), strict=True):
                    ends = gram_end[lo:hi]
                    ends = ends[ends <= hi]
                    if not len(ends):
                        per.append(0)
                        continue
                    stops = window_end[lo:hi]
                    stops = stops[stops <= hi] if total[hi] - total[lo] >= window_words else np.array([hi])
                    own = _joined(h[lo:hi], ends - lo)
                    picked = select(own.tolist(), (ends - lo).tolist(), (stops - lo).tolist())
                    per.append(len(picked))
                    position += picked
                    key.append(own[picked])
                keys = np.concatenate(key) if key else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        X.lists(h.view(np.int64), solid.counts, pa.int64()),
                        X.lists(n_words.astype(np.int32), solid.counts, pa.int32()),
                        X.lists(np.array(position, np.int32), np.array(per, int), pa.int32()),
                        X.lists(keys.view(np.int64), np.array(per, int), pa.int64()),
                    ],
                    names=["doc_id", "text_hash", "lines", "words", "positions", "keys"],
                )

    return run


def _joined(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs [i, ends[i]) of one document's line hashes."""
    up, down = X._power(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    i = np.arange(len(ends))
    return X.mix((total[ends] - total[i]) * down[i] + (ends - i).astype(np.uint64))


def _extend():
    """Lines of a document that equal those of its source at a distance of `shift`, around the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifts = batch.column("shift").to_pylist()
            seeds = batch.column("seeds")
            mine, other = batch.column("lines"), batch.column("source_lines")
            gone = []
            for k, shift in enumerate(shifts):
                a, b = mine[k].values.to_numpy(), other[k].values.to_numpy()
                lo, hi = max(0, shift), min(len(a), len(b) + shift)
                same = a[lo:hi] == b[lo - shift : hi - shift]
                stretch = np.concatenate([[0], np.cumsum(~same)])[:-1]
                at = seeds[k].values.to_numpy() - lo
                gone.append((np.flatnonzero(same & np.isin(stretch, stretch[at])) + lo).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), X.lists(np.concatenate(gone) if gone else np.zeros(0, np.int32), np.array([len(x) for x in gone], int), pa.int32())], names=["doc_id", "text_hash", "gone"])

    return run


def repeated_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, text_hash, gone): indexes among a document's lines with words that repeat earlier runs.

    One row per distinct (doc_id, text) with any. The first occurrence of a gram is a minimum, so a gram
    in a third of all documents is pre-aggregated before the shuffle; matches link each occurrence to
    that one place only, so their number grows with the input. Where occurrences are joined to that place,
    and matches to the lines of their source, a gram or source with many of them is salted.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text_hash", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType()))])
    marked = saved(spread(rows).mapInArrow(_fingerprints("text", gram_words, window_words), schema), "line-fingerprints")
    found = marked.select("doc_id", "text_hash", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("positions").alias("position"))).alias("f")).select("doc_id", "text_hash", F.col("f.key").alias("key"), F.col("f.position").alias("position"))
    place = F.struct("doc_id", "text_hash", "position")
    first = found.groupBy("key").agg(F.min(place).alias("source"), F.max(place).alias("last"), F.count("*").alias("n")).where(~F.col("source").eqNullSafe(F.col("last")))
    first = saved(first.select(F.col("key").alias("gram"), "source", "n"), "line-firsts")
    total = first.agg(F.sum("n").alias("n")).first()["n"] or 0
    later = salted_join(found, first.drop("n"), {"key": "gram"}, hot_keys(first, ["gram"], total), ["doc_id", "text_hash", "position"]).where(~place.eqNullSafe(F.col("source")))
    matches = later.groupBy("doc_id", "text_hash", F.col("source.doc_id").alias("source_id"), F.col("source.text_hash").alias("source_hash"), (F.col("position") - F.col("source.position")).alias("shift")).agg(F.collect_set("position").alias("seeds"))
    matches = saved(matches, "line-matches")
    bodies = marked.select("doc_id", "text_hash", "lines").dropDuplicates(["doc_id", "text_hash"])
    sources = bodies.select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), F.col("lines").alias("source_lines"))
    mine = bodies.select(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"), "lines")
    hot = hot_keys(matches.groupBy("source_id", "source_hash").agg(F.count("*").alias("n")), ["source_id", "source_hash"], matches.count())
    both = matches.join(mine, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash"))).drop("a_id", "a_hash")
    laid = salted_join(both, sources, {"source_id": "b_id", "source_hash": "b_hash"}, hot, ["doc_id", "text_hash", "shift"]).select("doc_id", "text_hash", "shift", "seeds", "lines", "source_lines")
    gone = laid.mapInArrow(_extend(), T.StructType([*schema.fields[:2], T.StructField("gone", T.ArrayType(T.IntegerType()))]))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _cut(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.portions(batch, text):
                t = X.texts(part.column(text))
                lines, solid, n_words, index = _solid(t)
                gone = part.column(_OWN[0])
                dropped = np.zeros(len(index), bool)
                counts = np.zeros(len(t), np.int64)
                for d in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    at = gone[d].values.to_numpy()
                    counts[d] = len(at)
                    dropped[solid.lo[d] + at] = True
                out = part.column(text)
                if counts.any():
                    stay = np.ones(len(lines), bool)
                    stay[index[dropped]] = False
                    new = out.to_pylist()
                    for d in np.flatnonzero(counts).tolist():
                        raw, base = t.raw(d), t.starts[d]
                        new[d] = b"\n".join(raw[s - base : e - base] for s, e, k in zip(lines.starts[lines.lo[d] : lines.hi[d]].tolist(), lines.ends[lines.lo[d] : lines.hi[d]].tolist(), stay[lines.lo[d] : lines.hi[d]].tolist(), strict=True) if k).decode("utf-8", "replace")
                    out = pa.array(new, type=pa.string())
                names = [n for n in part.schema.names if n not in (text, *_OWN)]
                columns = [out, pa.array(lines.counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(X.sums(n_words, solid), pa.int64()), pa.array(X.sums(np.where(dropped, n_words, 0), solid), pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *columns], names=[*names, text, "n_lines", "n_gone_lines", "n_line_words", "n_gone_words"])

    return run


#: Working columns of dedup_lines(); the leading space keeps them apart from columns of the input.
_OWN = (" gone", " text_hash")


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with later repeated runs cut from the texts, one row for each row of docs, text after the
    other columns; adds n_lines, n_gone_lines, n_line_words and n_gone_words.

    Lines without a word stay. Null texts stay null and empty ones empty. Rows equal in id and text count as one
    document and all get its result; rows of one id with different texts are ordered by a hash of the
    text. A null id comes before all others. Columns that have the names of results are replaced, others stay.
    """
    added = ["n_lines", "n_gone_lines", "n_line_words", "n_gone_words"]
    left = docs.drop(*added).withColumn(_OWN[1], F.xxhash64(F.coalesce(text, F.lit(""))))
    gone = repeated_lines(docs, text=text, doc_id=doc_id, **options).select(F.col("doc_id").alias(" id"), F.col("text_hash").alias(" hash"), F.col("gone").alias(_OWN[0]))
    both = left.join(gone, left[doc_id].eqNullSafe(gone[" id"]) & (left[_OWN[1]] == gone[" hash"]), "left").drop(" id", " hash")
    fields = [f for f in docs.drop(*added, text).schema.fields]
    schema = T.StructType([*fields, T.StructField(text, T.StringType()), *[T.StructField(n, T.LongType()) for n in added]])
    return both.mapInArrow(_cut(text), schema)
