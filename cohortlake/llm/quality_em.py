"""Quality classifier from weak labels.

Overlapping heuristic labellers vote bad, nothing or good on each document. A latent-class model, fitted
by expectation maximisation to how often each pattern of votes occurs over all documents, estimates
how each labeller votes on good and on bad documents, and so the posterior of each pattern. Posteriors
label a bounded sample, on which a linear scorer over hashed words and statistics is trained; it
scores every document and decides.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm import text as X
from cohortlake.llm.fertility import duplicate_lines
from cohortlake.llm.shared import saved, ship, spread

BAD, NONE, GOOD = 0, 1, 2
#: Labellers on one statistic each: bad beyond the first bound, good within the second, in the direction
#: of the sign (+1: large values are bad), no vote between or where the statistic needs more words.
LABELLERS = (
    ("symbols", +1, 0.05, 0.005, 5),
    ("marked_words", +1, 0.25, 0.05, 5),
    ("capitals", +1, 0.30, 0.12, 5),
    ("exclamations", +1, 0.20, 0.05, 5),
    ("distinct_words", -1, 0.35, 0.50, 40),
    ("repeated_lines", +1, 0.30, 0.05, 20),
    ("lone_marks", +1, 0.15, 0.03, 5),
    ("letters", -1, 0.60, 0.80, 5),
    ("digits", +1, 0.20, 0.08, 5),
    ("sentence_ends", -1, 0.01, 0.04, 20),
    ("word_length_off", +1, 6.0, 3.5, 5),
)
#: Hashed words, then LEVELS buckets for each statistic.
HASH_BITS = 16
LEVELS = 24
WIDTH = (1 << HASH_BITS) + LEVELS * (len(LABELLERS) + 1)
#: Documents that train the scorer, at most about so many.
SAMPLE = 8_000
THRESHOLD = 0.5

#: Kinds of characters, as bits; letters and digits by their Unicode categories.
_LETTER, _CAPITAL, _DIGIT, _SYMBOL, _BANG, _STOP, _UNSPACED = (1 << k for k in range(7))
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """The bits of every code point, made once in a process. Combining marks belong to letters."""
    global _kinds
    if _kinds is None:
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LM":
                out[c] = _LETTER | (_CAPITAL if kind == "Lu" else 0)
            elif kind == "Nd":
                out[c] = _DIGIT
        for bit, signs in ((_SYMBOL, "#*$%&|<>=~^{}[]\\"), (_BANG, "!\uff01"), (_STOP, ".?\u3002\uff1f\u061f\u0964\u06d4")):
            out[[ord(c) for c in signs]] |= bit
        # ideographs, kana and the scripts of South-East Asia are written without blanks between words
        for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF)):
            out[a : b + 1] |= _UNSPACED
        _kinds = out
    return _kinds


def statistics(t: X.Texts) -> tuple[np.ndarray, X.Pieces, np.ndarray]:
    """A row per labeller, a column per document; the words and their hashes. Empty texts are all 0.

    Characters are code points. Two of a script without blanks stand for a word beside the words."""
    p = X.pieces(t, X.SPACES)
    h = X.hashes(t.data, p.starts, p.ends, X.LOWER)
    kinds = _kind_table()[np.frombuffer(t.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    points = X.code_points(t.data)
    begins, ends, starts, stops = points[t.starts], points[t.ends], points[p.starts], points[p.ends]

    def before(bit: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum((kinds & bit) != 0)])

    def many(total: np.ndarray) -> np.ndarray:
        return total[ends] - total[begins]

    letters, marks, unspaced = before(_LETTER), before(_SYMBOL), many(before(_UNSPACED))
    n = np.maximum(p.counts + unspaced / 2, 1)
    doc = p.doc().astype(np.uint64)
    distinct = np.bincount(doc[np.unique(X.mix(h + doc * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]].astype(np.int64), minlength=len(t))
    sizes = X.sums(stops - starts, p)
    some = np.maximum(sizes, 1)
    rows = [
        many(marks) / some,
        X.sums(marks[stops] > marks[starts], p) / n,
        many(before(_CAPITAL)) / np.maximum(many(letters), 1),
        many(before(_BANG)) / n,
        # the usual growth of the vocabulary with the length is taken out
        distinct / np.maximum(p.counts, 1) * np.maximum(p.counts / 200, 1) ** 0.15,
        duplicate_lines(t, p) / np.maximum(X.lines(t).counts, 1),
        X.sums(letters[stops] == letters[starts], p) / n,
        many(letters) / some,
        many(before(_DIGIT)) / some,
        many(before(_STOP)) / n,
        np.abs(sizes / n - np.where(unspaced > sizes / 2, 2.0, 6.0)),
    ]
    return np.stack(rows), p, h


def votes(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """BAD, NONE or GOOD of each labeller on each document."""
    out = np.full(stats.shape, NONE, np.int8)
    for k, (_, sign, bad, good, least) in enumerate(LABELLERS):
        enough = n_words >= least
        out[k, enough & (sign * stats[k] >= sign * bad)] = BAD
        out[k, enough & (sign * stats[k] <= sign * good)] = GOOD
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    """Each document's votes as one number in base 3."""
    return (v.astype(np.int64) * 3 ** np.arange(len(v))[:, None]).sum(axis=0)


def features(stats: np.ndarray, p: X.Pieces, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (index, value, entries per document): hashed words of norm 1, and a bucket per statistic."""
    n = len(p.lo)
    doc = p.doc()
    key, count = np.unique((doc << HASH_BITS) | (h >> np.uint64(64 - HASH_BITS)).astype(np.int64), return_counts=True)
    row, value = key >> HASH_BITS, np.log1p(count)
    value /= np.sqrt(np.bincount(row, weights=value**2, minlength=n))[row] if len(row) else 1.0
    scale = np.array([[abs(bad - good) / 4] for _, _, bad, good, _ in LABELLERS])
    middle = np.array([[(bad + good) / 2] for _, _, bad, good, _ in LABELLERS])
    level = np.clip(np.floor((stats - middle) / scale) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)
    length = np.clip(np.log2(p.counts + 1), 0, LEVELS - 1).astype(np.int64)
    dense = np.concatenate([level, length[None]]) + (1 << HASH_BITS) + LEVELS * np.arange(len(LABELLERS) + 1)[:, None]
    rows = np.concatenate([row, np.tile(np.arange(n), len(dense))])
    order = np.argsort(rows, kind="stable")
    index = np.concatenate([key & ((1 << HASH_BITS) - 1), dense.ravel()])[order]
    values = np.concatenate([value, np.ones(dense.size)])[order]
    return index, values, np.bincount(rows, minlength=n)


@dataclass
class LabelModel:
    """prior: the share of good documents. bad[c, k]: how often labeller k, if it votes, votes bad on class
    c (0: bad, 1: good). A labeller that does not vote says nothing."""

    prior: float
    bad: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        v = _unpacked(pattern)
        gain_bad, gain_good = np.log(self.bad[1]) - np.log(self.bad[0]), np.log1p(-self.bad[1]) - np.log1p(-self.bad[0])
        odds = np.log(self.prior) - np.log1p(-self.prior) + (v == BAD) @ gain_bad + (v == GOOD) @ gain_good
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _unpacked(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit_labels(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation maximisation over the patterns, each weighted by its documents.

    It starts from the vote balance: a bad vote outweighs several good ones, since each labeller looks for
    one kind of fault. Counts are smoothed by one document.
    """
    v = _unpacked(pattern)
    good = 1 / (1 + np.exp(-(2.0 + (v == GOOD).sum(axis=1) * 0.5 - (v == BAD).sum(axis=1) * 6.0)))
    model = LabelModel(0.5, np.full((2, len(LABELLERS)), 0.5))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * count, good * count])
        bad, voted = weight @ (v == BAD), weight @ (v != NONE)
        total = weight.sum()
        model = LabelModel(float((weight[1].sum() + 1) / (total + 2)), (bad + 1) / (voted + 2))
        new = model.posterior(pattern)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return model


def fit_scorer(index: np.ndarray, value: np.ndarray, per: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels, by full-batch Adagrad."""
    w, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    row = np.repeat(np.arange(len(per)), per)
    for _ in range(epochs if len(per) else 0):
        z = np.bincount(row, weights=w[index] * value, minlength=len(per)) + w[-1]
        error = 1 / (1 + np.exp(-z)) - target
        slope = np.bincount(index, weights=error[row] * value, minlength=WIDTH + 1) / len(per) + decay * w
        slope[-1] = error.mean()
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
    return w


def _chosen(p: X.Pieces, h: np.ndarray, rows: np.ndarray) -> tuple[X.Pieces, np.ndarray]:
    """The words of some documents, and their hashes."""
    at, stops = X.spans(p.lo[rows], p.counts[rows]), np.cumsum(p.counts[rows])
    return X.Pieces(p.starts[at], p.ends[at], stops - p.counts[rows], stops), h[at]


def _observe(text: str):
    """Each document's pattern; of sampled ones its features too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.portions(batch, text):
                stats, p, h = statistics(X.texts(part.column(text)))
                chosen = part.column("sampled").to_numpy(zero_copy_only=False).astype(bool)
                rows = np.flatnonzero(chosen)
                index, value, own = features(stats[:, rows], *_chosen(p, h, rows))
                per = np.zeros(len(chosen), np.int64)
                per[rows] = own
                yield pa.RecordBatch.from_arrays([pa.array(patterns(votes(stats, p.counts))), part.column("key"), pa.array(chosen), X.binaries(index.astype(np.int32), per), X.binaries(value.astype(np.float32), per)], names=["pattern", "key", "sampled", "index", "value"])

    return run


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Vote counts are those of all documents. Distinct texts, `sample` of them at most but for the chance of the
    draw by a hash, train the scorer; copies of a text train it once."""
    spark = docs.sparkSession
    ship(spark)
    share = min(1.0, sample / max(1, docs.count()))
    key = F.xxhash64(F.lit("quality"), text)
    drawn = F.col(text).isNotNull() & (F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)))
    seen = saved(spread(docs.select(F.col(text).alias("text"), key.alias("key"), drawn.alias("sampled"))).mapInArrow(_observe("text"), "pattern long, key long, sampled boolean, index binary, value binary"), "votes")
    # at most 3 to the number of labellers
    counts = seen.groupBy("pattern").agg(F.count("*").alias("n")).toArrow()
    labels = fit_labels(counts.column("pattern").to_numpy(), counts.column("n").to_numpy())
    rows = seen.where("sampled").select("key", "pattern", "index", "value").dropDuplicates(["key"]).toArrow().sort_by("key")
    index = [np.frombuffer(x, np.int32) for x in rows.column("index").to_pylist()]
    value = [np.frombuffer(x, np.float32) for x in rows.column("value").to_pylist()]
    flat = (np.concatenate(a) if a else np.zeros(0, int) for a in (index, value))
    weights = fit_scorer(*flat, np.array([len(x) for x in index], int), labels.posterior(rows.column("pattern").to_numpy()))
    return QualityModel(labels, weights)


def _score(model, text: str, threshold: float, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: QualityModel = model.value
        for batch in batches:
            for part in X.portions(batch, text):
                stats, p, h = statistics(X.texts(part.column(text)))
                v = votes(stats, p.counts)
                index, value, per = features(stats, p, h)
                row = np.repeat(np.arange(len(per)), per)
                z = np.bincount(row, weights=m.weights[index] * value, minlength=len(per)) + m.weights[-1]
                score = 1 / (1 + np.exp(-z))
                names = [n for n in part.schema.names if keep or n != text]
                made = [pa.array(p.counts), pa.array((v == BAD).sum(axis=0).astype(np.int64)), pa.array((v == GOOD).sum(axis=0).astype(np.int64)), pa.array(m.labels.posterior(patterns(v))), pa.array(score), pa.array(score >= threshold)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *made], names=[*names, *_ADDED])

    return run


_ADDED = ("n_words", "votes_bad", "votes_good", "label_posterior", "score", "kept")


def classify(docs: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with n_words, votes, label_posterior (that the document is good), score and kept (score >= threshold).

    One row per row. A null text is an empty one, on which no labeller votes: the prior and the
    statistics of empty texts decide. Columns that have the names of results are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*_ADDED)
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 2 + [T.BooleanType()]
    schema = T.StructType([*(docs if keep_text else docs.drop(text)).schema.fields, *[T.StructField(n, k) for n, k in zip(_ADDED, kinds, strict=True)]])
    return spread(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), text, threshold, keep_text), schema)
