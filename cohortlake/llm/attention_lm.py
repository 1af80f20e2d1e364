"""A causal self-attention model over subword ids, trained in numpy, beside a smoothed unigram base.

The model predicts the class of the next subword, then the subword in its class:

    p(id | context) = softmax(table[before] + (attention over the window + embedding[before]) @ out)[class(id)]
                      * p(id | class(id), before)

`table` and the second factor come from counts of subword pairs inside words over every training document
(the word counts are aggregated once, and only distinct words are encoded); pairs that were not seen back off
to the counts of the subwords alone, kept apart for those that begin a word. Attention (one layer, learned
biases for relative positions) moves the classes by what stands in the window: language, style, neighbours.
Its weights, and the neighbours by which classes are made, come from every training document. A start is
fitted on a few of their windows; then all documents go once through gradient steps, task by task from that
start, and the tasks' weights are averaged by their ids.

Texts are scored in windows of KEYS ids that overlap: each window scores its last QUERIES ids, which see
the ids before them in the window, so each id is scored once. All matrices that act on a single id are
folded into tables before scoring. Every text is scored by this one formula, in which words have no share of
their own: a word known from training is likely because its subwords are likely after each other.
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

from cohortlake.llm import text as X
from cohortlake.llm.shared import most_frequent, partitions, saved, ship, spread
from cohortlake.llm.tokens import Slots, WordEncoder, encoder

KEYS, QUERIES = 24, 16
WIDTH = 16
CLASSES = 96
#: Subwords with an embedding, pairs and a class of their own making; the others share those of their frequency.
COMMON_IDS = 3_000
RARE_GROUPS = 12
#: Subwords whose places before and after others make the classes, beside one for all others.
NEIGHBOURS = 400
#: Weight, in observations, of the counts of subwords alone beside those of pairs.
BACKOFF = 5.0
#: Ids that a task learns from, about, at least: weights after few steps are worse averaged.
LEAST_IDS = 4_000_000
#: Of no effect: attention learns from all training documents. Kept because a test still sets it.
TRAIN_SHARE = 1.0
#: Ids of the windows, about, from which the weights start.
START_IDS = 600_000
EPOCHS, BATCH, RATE = 4, 128, 1.5e-2
#: First rate of the steps over all training documents.
WHOLE_RATE = 5e-3
#: Parts in which tasks' sums travel.
SLICES = 64
#: Distinct words of a task that are held before their counts are passed on.
HELD_WORDS = 500_000
#: Words whose counts are broadcast for the base, at most; those of others are joined, with the same result.
HEAD_WORDS = 200_000
END = "\n"


@dataclass
class Counts:
    """Corpus counts: stated[0 or 1, id] at the beginning of words or inside; pairs (before, id, n) inside words."""

    stated: np.ndarray
    before: np.ndarray
    after: np.ndarray
    n: np.ndarray
    closing: np.ndarray


@dataclass
class Model:
    """Folded tables. group: id -> input row; the rows of query, key, value and direct are per group;
    cls: id -> class; place: id -> column of pair, -1 for ids without; row: group -> row of pair, 0 where a
    word begins; pair: log p(id | class, row); alone[0 or 1, id]: log p(id | class) where a word begins, or
    inside one; near: bias by distance; out: value -> classes."""

    group: np.ndarray
    cls: np.ndarray
    place: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    alone: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    direct: np.ndarray
    near: np.ndarray
    out: np.ndarray
    start: int

    def inside(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """ln p of each id in its class, after the groups before it."""
        row, at = self.row[before], self.place[ids]
        return np.where(at >= 0, self.pair[row, at], self.alone[(row > 0).astype(np.int8), ids])

    def score(self, ids: np.ndarray, counts: np.ndarray, batch: int = 128) -> np.ndarray:
        """ln p of each id, given those before it in its document; counts[i] of them lie in a row."""
        out = np.zeros(len(ids))
        if not len(ids):
            return out
        # inputs, document by document: padding with the start id, then the ids; an id's input is the one before it.
        # A document takes whole steps of QUERIES inputs, so that windows, and some that none needs, lie at even distances
        lead = KEYS - QUERIES + 1
        steps = -(-counts // QUERIES) + -(-lead // QUERIES)
        at = (np.cumsum(steps) - steps) * QUERIES
        inputs = np.full(int(steps.sum()) * QUERIES + KEYS - QUERIES, self.start, np.int32)
        inputs[X.spans(at + lead, counts)] = self.group[ids]
        real = np.zeros(int(steps.sum()) * QUERIES, bool)
        real[X.spans(at, counts)] = True
        before = np.empty(len(ids), np.int32)
        before[1:] = self.group[ids[:-1]]
        before[(np.cumsum(counts) - counts)[counts > 0]] = self.start
        cls, inside = self.cls[ids], self.inside(ids, before)
        reach = np.arange(QUERIES)[:, None] + (KEYS - QUERIES) - np.arange(KEYS)[None, :]
        bias = np.where(reach >= 0, self.near[np.maximum(reach, 0)], -1e9).astype(np.float32)
        folded, d = np.concatenate([self.query, self.key, self.value], axis=1), self.query.shape[1]
        done = 0
        for a in range(0, len(real), batch * QUERIES):
            here = real[a : a + batch * QUERIES]
            x = inputs[a : a + len(here) + KEYS - QUERIES]
            f = np.take(folded, x, axis=0)
            query = f[KEYS - QUERIES :, :d].reshape(-1, QUERIES, d)
            key, value = (np.lib.stride_tricks.as_strided(f[:, k * d :], (len(query), KEYS, d), (QUERIES * f.strides[0], *f.strides)) for k in (1, 2))
            s = np.matmul(query, key.transpose(0, 2, 1))
            s += bias
            s, sums, _ = _exponents(s)
            mixed = np.matmul(s, value).reshape(len(here), -1)
            mixed /= sums.reshape(-1, 1)
            mixed, rows = mixed[here], x[KEYS - QUERIES :][here]
            logits = mixed @ self.out
            logits += np.take(self.direct, rows, axis=0)
            _, sums, top = _exponents(logits)
            to = done + len(rows)
            out[done:to] = logits[np.arange(len(rows)), cls[done:to]] - top - np.log(sums) + inside[done:to]
            done = to
        return out


def _exponents(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponents of the rows of s, their sums, and what was taken off each row before: its maximum where the sum
    would come near the ends of 32-bit floats, else 0."""
    ones = np.ones(s.shape[-1], np.float32)
    with np.errstate(over="ignore"):
        made = np.exp(s)
        rows = made.reshape(-1, len(ones))
        sums = rows @ ones
    top = np.zeros_like(sums)
    if not (1e-20 < sums.min(initial=1) and sums.max(initial=1) < 1e20):
        far = np.flatnonzero(~((1e-20 < sums) & (sums < 1e20)))
        own = s.reshape(-1, len(ones))[far]
        top[far] = own.max(axis=1)
        rows[far] = np.exp(own - top[far, None])
        sums[far] = rows[far] @ ones
    return made, sums, top


def _rare(counts: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(counts + 1), 0, RARE_GROUPS - 1).astype(np.int64)


def _common(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")[: min(COMMON_IDS, int((counts > 0).sum()))]


def _neighbours(ids: np.ndarray, per: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """How often a neighbour (wide of them, and others) stands before and after each of n common ids, and of the
    others at row n; the end of a document, which is its last id, stands before its first."""
    wide = min(n, NEIGHBOURS)
    b = place[ids]
    a = np.empty_like(b)
    a[1:] = b[:-1]
    stops = np.cumsum(per)[per > 0]
    a[stops - per[per > 0]] = b[stops - 1]
    cells = (n + 1) * (wide + 1)
    return np.stack([np.bincount(x * (wide + 1) + np.minimum(y, wide), minlength=cells) for x, y in ((b, a), (a, b))]).reshape(2, n + 1, wide + 1)


def _place(common: np.ndarray, size: int) -> np.ndarray:
    place = np.full(size, len(common), np.int64)
    place[common] = np.arange(len(common))
    return place


def _classes(pairs: np.ndarray, common: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id: common ones by k-means on what stands before and after them, others by frequency."""
    n, k = len(common), CLASSES - RARE_GROUPS
    wide = min(n, NEIGHBOURS)
    before, after = pairs.astype(np.float32)
    f = np.concatenate([np.sqrt(m[:n] / np.maximum(m[:n].sum(axis=1, keepdims=True), 1)) for m in (before, after)], axis=1)
    f[:, : wide + 1] *= 1.5
    f = np.concatenate([f, np.log10(counts[common] + 1)[:, None] * 0.15], axis=1).astype(np.float32)
    weight = np.sqrt(counts[common] + 1.0)
    centres = f[rng.choice(n, min(k, n), replace=False, p=weight / weight.sum())] if n else f
    own = np.zeros(n, np.int64)
    for _ in range(20 if n else 0):
        own = ((f**2).sum(axis=1)[:, None] - 2 * f @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = np.average(f[mine], axis=0, weights=weight[mine])
    cls = k + _rare(counts)
    cls[common] = own
    return cls


def _windows(lead: np.ndarray, ids: np.ndarray, per: np.ndarray, start: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Windows of KEYS ids, document by document: what `lead` has for the id before (start: none), and the ids (-1: none)."""
    many = -(-per // KEYS)
    stops = np.cumsum(many * KEYS)
    at = X.spans(stops - many * KEYS, per)
    after = np.full(int(stops[-1]) if len(stops) else 0, -1, ids.dtype)
    after[at] = ids
    before = np.full(len(after), start, lead.dtype)
    before[at[1:]] = lead[:-1]
    before[(stops - many * KEYS)[per > 0]] = start
    return before.reshape(-1, KEYS), after.reshape(-1, KEYS)


def fit(documents: list[np.ndarray], counts: Counts, seed: int = 0) -> Model:
    """From documents (ids with the end id), all of whose windows are used for the start, and the corpus counts."""
    per = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate([np.zeros(0, np.int64), *documents]).astype(np.int64)
    common = _common(counts.stated.sum(axis=0))
    frame = Frame.of(counts, _neighbours(ids, per, _place(common, counts.stated.shape[1]), len(common)), seed)
    return frame.model(frame.start_weights(*_windows(ids, ids, per), seed))


@dataclass
class Frame:
    """What counts fix before any weight is learnt: groups, classes, and the tables by the subword before."""

    group: np.ndarray
    cls: np.ndarray
    place: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    alone: np.ndarray
    table: np.ndarray
    start: int

    @classmethod
    def of(cls, counts: Counts, neighbours: np.ndarray, seed: int = 0) -> Frame:
        both = counts.stated.sum(axis=0).astype(np.float64)
        common = _common(both)
        n = len(common)
        place = _place(common, len(both))
        # rare ids that close a word and those that do not are in groups of their own
        group = n + _rare(both) + RARE_GROUPS * counts.closing
        group[common] = np.arange(n)
        start = n + 2 * RARE_GROUPS
        ends = np.concatenate([counts.closing[common], np.arange(2 * RARE_GROUPS + 1) >= RARE_GROUPS])
        row = np.where(ends, 0, np.cumsum(~ends))
        own = _classes(neighbours, common, both, np.random.default_rng(seed))

        per_class = lambda x: np.bincount(own, weights=x, minlength=CLASSES)
        smooth = both + 0.5
        # a state's counts, with those of both at the weight of a few observations per class
        blended = counts.stated + 20 * (smooth / np.maximum(per_class(smooth), 0.5)[own])
        alone = np.stack([np.log(x) - np.log(np.maximum(per_class(x), 1e-9))[own] for x in blended])
        states = np.stack([per_class(x) + 1e-3 * per_class(smooth) / smooth.sum() * max(1.0, both.sum()) + 1e-6 for x in counts.stated])
        states /= states.sum(axis=1, keepdims=True)

        rows = int(row.max()) + 1
        seen = np.zeros((rows, n + 1))
        np.add.at(seen, (row[group[counts.before]], np.where(place[counts.after] < n, place[counts.after], n)), counts.n)
        # pairs with rare ids only move the table: they are in classes of their own
        classed = np.zeros((rows, CLASSES))
        np.add.at(classed, (row[group[counts.before]], own[counts.after]), counts.n)
        share = np.exp(alone[1][common])
        pair = np.log((seen[:, :n] + BACKOFF * share) / (classed[:, own[common]] + BACKOFF))
        table = np.log((classed + BACKOFF * states[1]) / (classed.sum(axis=1, keepdims=True) + BACKOFF))
        pair[0], table[0] = alone[0][common], np.log(states[0])
        # one column more, which ids without one point at
        pair = np.concatenate([pair, np.zeros((rows, 1))], axis=1)
        columns = np.where(place < n, place, -1)
        return cls(group.astype(np.int32), own.astype(np.int32), columns.astype(np.int32), row.astype(np.int32), pair.astype(np.float32), alone.astype(np.float32), table[row].astype(np.float32), start)

    def start_weights(self, before: np.ndarray, after: np.ndarray, seed: int = 0) -> dict:
        """Weights fitted on windows of ids before and ids."""
        rng, d = np.random.default_rng(seed), WIDTH
        p = {"e": rng.normal(0, 0.3, (self.start + 1, d)), "near": np.zeros(KEYS), "out": rng.normal(0, 0.1, (d, CLASSES)), "bias": np.zeros(CLASSES), **{n: rng.normal(0, d**-0.5, (d, d)) for n in ("q", "k", "v")}}
        p = {n: x.astype(np.float32) for n, x in p.items()}
        x, y = np.where(before < 0, self.start, self.group[before]), np.where(after < 0, -1, self.cls[after])
        steps = EPOCHS * max(1, len(x) // BATCH)
        descent = _Descent(p, self.table, self.start)
        for _ in range(EPOCHS):
            for chosen in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                if len(chosen):
                    step = descent.steps + 1
                    descent.step(x[chosen], y[chosen], RATE * (1 - step / (steps + 1)) * min(1, step / 50))
        return descent.p

    def model(self, p: dict) -> Model:
        e = p["e"]
        return Model(self.group, self.cls, self.place, self.row, self.pair, self.alone, e @ p["q"] / np.float32(np.sqrt(WIDTH)), e @ p["k"], e @ p["v"], e @ p["out"] + p["bias"] + self.table, p["near"], p["out"], self.start)


class _Descent:
    """Adam steps on weights like p, which lie in one row, `flat`."""

    def __init__(self, p: dict, table: np.ndarray, start: int):
        self.table, self.start, self.steps = table, start, 0
        self.flat = np.concatenate([x.ravel() for x in p.values()])
        self.slope, self.first, self.second, self.change = (np.zeros_like(self.flat) for _ in range(4))
        self.p, self.slopes = ({n: v.reshape(x.shape) for (n, x), v in zip(p.items(), np.split(row, np.cumsum([x.size for x in p.values()])[:-1]), strict=True)} for row in (self.flat, self.slope))
        self.reach = np.arange(KEYS)[:, None] - np.arange(KEYS)[None, :]

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        self.steps += 1
        _slopes(self.p, self.slopes, self.table, x, y, self.reach, self.start)
        s, c = self.slope, self.change
        np.subtract(s, self.first, out=c)
        c *= 0.1
        self.first += c
        np.multiply(s, s, out=c)
        c -= self.second
        c *= 0.01
        self.second += c
        np.multiply(self.second, 1 / (1 - 0.99**self.steps), out=c)
        np.sqrt(c, out=c)
        c += 1e-8
        np.divide(self.first, c, out=c)
        c *= rate / (1 - 0.9**self.steps)
        self.flat -= c


def _slopes(p: dict, out: dict, table: np.ndarray, x: np.ndarray, y: np.ndarray, reach: np.ndarray, start: int) -> None:
    """Into out: gradients of the mean cross-entropy of classes y (-1: none) after inputs x."""
    b, t = x.shape
    d = p["e"].shape[1]
    real = (y >= 0).ravel()
    cls = np.maximum(y, 0).ravel()
    at = np.where(y >= 0, x, start).ravel()
    es = np.take(p["e"], at, axis=0)
    root = np.float32(np.sqrt(d))
    three = np.concatenate([p["q"] / root, p["k"], p["v"]], axis=1)
    qkv = (es @ three).reshape(b, t, 3 * d)
    q, k, v = (qkv[:, :, i * d : (i + 1) * d] for i in range(3))
    bias = np.where(reach >= 0, p["near"][np.maximum(reach, 0)], -1e9).astype(np.float32)
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += bias
    a, sums, _ = _exponents(a)
    mixed = np.matmul(a, v).reshape(b * t, d)
    mixed /= sums[:, None]
    # one column of ones more, for the bias
    h = np.ones((b * t, d + 1), np.float32)
    np.add(mixed, es, out=h[:, :d])
    last = np.concatenate([p["out"], p["bias"][None, :]])
    flat = h @ last
    flat += np.take(table, at, axis=0)
    flat, total, _ = _exponents(flat)
    # rows are held as multiples: times `scale` they are the slopes of the logits
    flat.ravel()[np.arange(0, flat.size, flat.shape[1]) + cls] -= total
    scale = (real / (total * np.float32(max(1, real.sum()))))[:, None].astype(np.float32)
    dh = flat @ p["out"].T
    dh *= scale
    h *= scale
    slope = (flat.T @ h).T
    # a is held as multiples too: over `sums` its rows are the shares
    dz = dh / sums[:, None]
    ds = np.matmul(dz.reshape(b, t, d), v.transpose(0, 2, 1))
    ds -= np.einsum("ij,ij->i", dz, mixed).reshape(b, t, 1)
    ds *= a
    dqkv = np.empty_like(qkv)
    np.matmul(ds, k, out=dqkv[:, :, :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), dz.reshape(b, t, d), out=dqkv[:, :, 2 * d :])
    dqkv = dqkv.reshape(b * t, 3 * d)
    de = dh + dqkv @ three.T
    out["e"][:] = np.bincount((at[:, None] * d + np.arange(d)).ravel(), weights=de.ravel(), minlength=p["e"].size).reshape(p["e"].shape)
    # where an id is after the one it would be seen by, ds is 0
    out["near"][:] = np.bincount(np.maximum(reach, 0).ravel(), weights=np.ones(b, np.float32) @ ds.reshape(b, t * t), minlength=KEYS)
    out["out"][:], out["bias"][:] = slope[:d], slope[d]
    each = es.T @ dqkv
    out["q"][:], out["k"][:], out["v"][:] = each[:, :d] / root, each[:, d : 2 * d], each[:, 2 * d :]


def _prepare(shared, file: str, end: int, text: str):
    """Each text's ids, and what the base needs of it: words and ends, those in the head, their logs, the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs = shared.value
        e = encoder(file, False, WordEncoder)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in X.portions(batch, text):
                t = X.texts(part.column(text))
                p = X.pieces(t, X.SPACES)
                h = X.hashes(t.data, p.starts, p.ends, X.LOWER)
                if len(head):
                    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
                    known = head[at] == h
                    gain = np.where(known, logs[at], 0)
                else:
                    known, gain = np.zeros(len(h), bool), np.zeros(len(h))
                ids = X.binaries(*e.ended(*e.encode_pieces(t, p, h), end))
                rest = [n for n in part.schema.names if n != text]
                made = [pa.array(np.arange(row, row + len(t))), pa.array(p.counts + 1), pa.array(X.sums(known, p)), pa.array(X.sums(gain, p)), X.lists(h[~known].view(np.int64), X.sums(~known, p)), ids]
                row += len(t)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in rest], *made], names=[*rest, *_MADE])

    return run


def _ids(part: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of ids of encoded documents."""
    t = X.texts(part.column(" ids").cast(pa.large_binary()).view(pa.large_string()))
    return np.ascontiguousarray(t.data).view(kind).astype(np.int64), (t.ends - t.starts) // kind.itemsize


def _documents(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, about a million ids at a time."""
    for batch in batches:
        for part in X.portions(batch, " ids"):
            yield _ids(part, kind)


def _sliced(values: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(values, SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), X.binaries(values, np.array([len(x) for x in parts]))], names=["slice", "part"])


def _summed(made: DataFrame, kind: np.dtype) -> np.ndarray:
    """The sum of the vectors that tasks have sliced, as doubles; empty if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0.0) + np.frombuffer(raw, kind).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "part"])

    found = made.repartition(partitions(made.sparkSession), "slice").mapInArrow(run, "slice int, part binary").toArrow().sort_by("slice")
    return np.frombuffer(b"".join(found.column("part").to_pylist()), np.float64)


def _count_neighbours(kind: np.dtype, place: np.ndarray, n: int):
    """(cell, n) of _neighbours(), those that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for ids, per in _documents(batches, kind):
            found = _neighbours(ids, per, place, n).ravel()
            total = found if total is None else np.add(total, found, out=total)
        if total is not None:
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    return run


def _draw(kind: np.dtype, share: float, seed: int):
    """Windows whose hash falls into the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(0).integers(1, 1 << 62, KEYS + 1, np.uint64) | np.uint64(1)
        for ids, per in _documents(batches, kind):
            before, after = _windows(ids, ids, per)
            keys = after.view(np.uint64) @ factors[:KEYS] + before[:, 0].view(np.uint64) * factors[KEYS]
            drawn = X.mix(X.mix(keys) + np.uint64(seed)) >> np.uint64(34) < np.uint64(int(share * (1 << 30)))
            both = np.concatenate([before[drawn], after[drawn]], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([X.binaries(both.ravel(), np.full(len(both), 2 * KEYS))], names=["window"])

    return run


def _descend(shared, kind: np.dtype):
    """The task's weights after steps over all its documents, times its number of ids, and that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, group, cls, table, start = shared.value
        descent = _Descent(p, table, start)
        done, rng = 0, np.random.default_rng(0)
        for ids, per in _documents(batches, kind):
            x, y = _windows(group[ids], cls[ids], per, start)
            for chosen in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                descent.step(x[chosen], y[chosen], WHOLE_RATE * min(1, (descent.steps + 1) / 50) / (1 + descent.steps / 200) ** 0.5)
            done += len(ids)
        if done:
            yield _sliced(np.append(descent.flat.astype(np.float64) * done, float(done)))

    return run


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(X.LOWER[data[X.spans(starts, sizes)]]))]).cast(pa.string())


def _count_words(text: str):
    """(word, n), each word once a task, or once for HELD_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, words, counts, ends = Slots(), [], np.zeros(0, np.int64), 0
        for batch in batches:
            for part in X.portions(batch, text, 8 << 20):
                t = X.texts(part.column(text))
                p = X.pieces(t, X.SPACES)
                at, new = slots.number(X.hashes(t.data, p.starts, p.ends, X.LOWER))
                words.append(_strings(t.data, p.starts[new], p.ends[new]))
                counts = np.bincount(at, minlength=slots.many) + np.append(counts, np.zeros(len(new), np.int64))
                ends += len(t)
                if slots.many > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(words), pa.array(counts)], names=["word", "n"])
                    slots, words, counts = Slots(), [], np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([*words, pa.array([END])]), pa.array(np.append(counts, ends))], names=["word", "n"])

    return run


def _encode_words(file: str):
    """(hash, n, ids) of each word of the count table; the end has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file, False, WordEncoder)
        for batch in batches:
            if batch.num_rows:
                t = X.texts(batch.column("word"))
                p = X.pieces(t, X.SPACES)
                ids, per = e.encode_pieces(t, p, X.hashes(t.data, p.starts, p.ends, X.LOWER))
                yield pa.RecordBatch.from_arrays([pa.array(X.hashes(t.data, t.starts, t.ends, X.LOWER).view(np.int64)), batch.column("n"), X.binaries(ids.astype(np.int32), per)], names=["hash", "n", "ids"])

    return run


def _word_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of a count table, whether each stands inside its word after one that does not close it, and the word's count."""
    raw = batch.column("ids").to_pylist()
    per = np.array([len(x) // 4 for x in raw], np.int64)
    ids = np.frombuffer(b"".join(raw), np.int32).astype(np.int64)
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(per) - per)[per > 0]] = True
    return ids, first, np.repeat(batch.column("n").to_numpy(), per)


def _count_ids(size: int, closing: np.ndarray):
    """(id, n) over words; ids that begin no pre-token are counted apart, as size + id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            ids, first, n = _word_ids(batch)
            inside = ~first
            inside[1:] &= ~closing[ids[:-1]]
            total += np.bincount(ids + size * inside, weights=n, minlength=2 * size).astype(np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["id", "n"])

    return run


def _count_pairs(size: int, closing: np.ndarray, common: np.ndarray):
    """(pair, n) over words: before * size + id inside pre-tokens. Rare ids count as the first one of their kind:
    pairs are few whatever the corpus, (COMMON_IDS + 2 RARE_GROUPS) squared at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, n = _word_ids(batch)
            at = np.flatnonzero(~first)
            at = at[~closing[ids[at - 1]]]
            pair, back = np.unique(common[ids[at - 1]] * size + common[ids[at]], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(back, weights=n[at], minlength=len(pair)).astype(np.int64))], names=["pair", "n"])

    return run


def _closing(e, size: int) -> np.ndarray:
    """Which ids end a pre-token, by the mark that word vocabularies give them; none in others."""
    out = np.zeros(size, bool)
    out[[i for t, i in e.splitting.get_vocab(with_added_tokens=True).items() if t.endswith("</w>") or i == e.mark_id]] = True
    return out


def _score(shared, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in X.portions(batch, " ids"):
                ids, per = _ids(part, kind)
                stops = np.cumsum(per)
                total = np.concatenate([[0], np.cumsum(model.score(ids, per))])
                rest = [n for n in part.schema.names if n != " ids"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in rest], pa.array((total[stops] - total[stops - per]) / np.log(10))], names=[*rest, "score"])

    return run


#: Working columns before scoring; the leading space keeps them apart from columns of the input.
_MADE = (" row", "n_tokens", " n_head", " head_logs", " tail", " ids")
_RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


@dataclass
class Words:
    """Of the training words: the table (hash, n, ids) with the end, how many, distinct ones, documents."""

    table: DataFrame
    n: int
    distinct: int
    documents: int


@dataclass
class Learnt:
    model: Model
    words: Words


def _words(docs: DataFrame, file: str, text: str) -> Words:
    counted = spread(docs.select(text)).mapInArrow(_count_words(text), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    table = saved(counted.mapInArrow(_encode_words(file), "hash long, n long, ids binary"), "word-counts")
    facts = table.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    return Words(table, facts["n"] or 0, facts["v"], docs.count())


def _prepared(docs: DataFrame, words: Words, file: str, text: str) -> DataFrame:
    """docs with _MADE in place of the text, written: each text is encoded once, for learning and for scores."""
    top = most_frequent(words.table.select("hash", "n"), "n", HEAD_WORDS).toArrow()
    head, many = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(head)
    shared = docs.sparkSession.sparkContext.broadcast((head[order], np.log10(many[order] + 0.1)))
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.ArrayType(T.LongType()), T.BinaryType()]
    schema = T.StructType([*docs.drop(text).schema.fields, *[T.StructField(n, k) for n, k in zip(_MADE, kinds, strict=True)]])
    return saved(spread(docs).mapInArrow(_prepare(shared, file, encoder(file, False).mark_id, text), schema), "encoded")


def learn(docs: DataFrame, *, file: str, text: str = "text", seed: int = 0, start_ids: int = START_IDS) -> Learnt:
    """From all rows of docs: counts of words, subwords and their pairs, and attention, all from every text."""
    ship(docs.sparkSession)
    docs = docs.select(text)
    words = _words(docs, file, text)
    return _learn(_prepared(docs, words, file, text), words, file, seed, start_ids)


def _learn(encoded: DataFrame, words: Words, file: str, seed: int, start_ids: int) -> Learnt:
    """The same from what _prepared() makes of the documents, and their words."""
    spark, encoded = encoded.sparkSession, encoded.select(" ids")
    e = encoder(file, False)
    end = e.mark_id
    size = max(end + 1, e.vocabulary_size)
    closing, stated = _closing(e, size), np.zeros((2, size), np.int64)
    spelt = words.table.where(F.octet_length("ids") > 0)
    found = spelt.mapInArrow(_count_ids(size, closing), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    stated.ravel()[found.column("id").to_numpy()] = found.column("n").to_numpy()
    stated[0, end] += words.documents
    both = stated.sum(axis=0)
    common = _common(both)
    place = _place(common, size)
    kind = np.where(place < len(common), place, len(common) + _rare(both) + RARE_GROUPS * closing)
    stands = np.unique(kind, return_index=True)[1][np.unique(kind, return_inverse=True)[1]]
    pairs = spelt.mapInArrow(_count_pairs(size, closing, stands), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair = pairs.column("pair").to_numpy()
    counts = Counts(stated, pair // size, pair % size, pairs.column("n").to_numpy(), closing)

    total = int(both.sum())
    kind = np.dtype(e.kind)
    cells = encoded.mapInArrow(_count_neighbours(kind, place, len(common)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    neighbours = np.zeros(2 * (len(common) + 1) * (min(len(common), NEIGHBOURS) + 1))
    neighbours[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    frame = Frame.of(counts, neighbours.reshape(2, len(common) + 1, -1), seed)
    some = encoded.mapInArrow(_draw(kind, min(1.0, start_ids / max(1, total)), seed), "window binary").distinct().toArrow().column(0)
    start = np.frombuffer(b"".join(sorted(some.to_pylist())), np.int32).reshape(-1, 2, KEYS).astype(np.int64)
    p = frame.start_weights(start[:, 0], start[:, 1], seed)
    shared = spark.sparkContext.broadcast((p, frame.group, frame.cls, frame.table, frame.start))
    made = _summed(encoded.coalesce(max(1, total // LEAST_IDS)).mapInArrow(_descend(shared, kind), "slice int, part binary"), np.dtype(np.float64))
    if len(made):
        parts = np.split((made[:-1] / made[-1]).astype(np.float32), np.cumsum([x.size for x in p.values()])[:-1])
        p = {n: v.reshape(x.shape) for (n, x), v in zip(p.items(), parts, strict=True)}
    return Learnt(frame.model(p), words)


def score(docs: DataFrame, *, file: str, train: str = "train", text: str = "text", seed: int = 0, start_ids: int = START_IDS) -> DataFrame:
    """docs without the text and the flag `train`, with n_tokens, n_known, train_tokens, base_score, score.

    Rows whose flag is true are learnt from. Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased and one
    end. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))). score is the model's log10 probability of the
    text's subwords and an end. A null text is empty: an end alone. One row per row; nothing is joined by
    document ids, so null and repeated ones change nothing. Without training rows all counts are 0. Columns
    that have the names of results are replaced, others stay.
    """
    ship(docs.sparkSession)
    flag = F.coalesce(train, F.lit(False))
    docs = docs.drop(*_RESULTS).withColumn(train, flag)
    words = _words(docs.where(train), file, text)
    encoded = _prepared(docs.withColumnRenamed(train, " train"), words, file, text)
    return _scored(encoded.drop(" train"), _learn(encoded.where("` train`"), words, file, seed, start_ids), file)


def score_with(docs: DataFrame, learnt: Learnt, *, file: str, text: str = "text") -> DataFrame:
    """The same for all rows of docs, by what was learnt before."""
    ship(docs.sparkSession)
    return _scored(_prepared(docs.drop(*_RESULTS), learnt.words, file, text), learnt, file)


def _scored(encoded: DataFrame, learnt: Learnt, file: str) -> DataFrame:
    words, table = learnt.words, learnt.words.table.select("hash", "n")
    shared = encoded.sparkSession.sparkContext.broadcast(learnt.model)
    rest = encoded.drop(" tail")
    schema = T.StructType([*rest.drop(" ids").schema.fields, T.StructField("score", T.DoubleType())])
    scored = saved(rest.mapInArrow(_score(shared, np.dtype(encoder(file, False).kind)), schema), "scored")
    tail = encoded.select(F.col(" row").alias(" tail_row"), F.explode(" tail").alias("hash")).join(table, "hash", "left")
    tail = tail.groupBy(" tail_row").agg(F.count("n").alias(" n_tail"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias(" tail_logs"))
    floor = float(np.log10(words.n + 0.1 * (words.distinct + 1)))
    joined = scored.join(tail, F.col(" row") == F.col(" tail_row"), "left")
    return joined.select(
        *encoded.drop(*_MADE).columns,
        "n_tokens",
        (F.col(" n_head") + F.coalesce(" n_tail", F.lit(0)) + (1 if words.documents else 0)).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col(" head_logs") + F.coalesce(" tail_logs", F.lit(0.0)) + F.lit(float(np.log10(words.documents + 0.1))) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
