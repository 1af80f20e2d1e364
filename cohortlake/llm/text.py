"""Array kernels over Arrow string columns: word and line bounds, 64-bit hashes, shingles.

Every kernel works on the UTF-8 bytes of a whole batch at once. Bytes of characters above U+007F are
never separators here, so cutting at ASCII bytes is exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        lut[lo : hi + 1] = True
    return lut


#: Separators of words [^\x20\x09-\x0D]+.
SPACES = _table((0x20, 0x20), (0x09, 0x0D))
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: A-Z count as letters.
NOT_ALNUM = _table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
NEWLINE = _table((0x0A, 0x0A))
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32


@dataclass
class Texts:
    """The UTF-8 bytes of a string column; document i is data[starts[i]:ends[i]]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


@dataclass
class Pieces:
    """Words or lines of some Texts: bytes [starts, ends) in data; those of document i are lo[i]..hi[i]."""

    starts: np.ndarray
    ends: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return self.hi - self.lo

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo)), self.counts)


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[at : at + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = bounds[0]
    return Texts(whole[base : bounds[-1]], bounds[:-1] - base, bounds[1:] - base)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def portions(batch: pa.RecordBatch, name: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        gone = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, gone + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def pieces(t: Texts, separators: np.ndarray) -> Pieces:
    """Maximal runs of bytes that are no separators, inside each document."""
    data = t.data
    inside = ~separators[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return Pieces(z, z, np.zeros(len(t), np.int64), np.zeros(len(t), np.int64))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    full = t.starts < t.ends
    first = t.starts[full]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = t.ends[full] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Pieces(starts, ends, np.searchsorted(starts, t.starts), np.searchsorted(starts, t.ends))


def lines(t: Texts) -> Pieces:
    """The lines between line feeds, empty ones too; an empty text has one empty line."""
    breaks = np.flatnonzero(t.data == 10)
    lo, hi = np.searchsorted(breaks, t.starts), np.searchsorted(breaks, t.ends)
    counts = hi - lo + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    is_first, is_last = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    is_first[bounds[:-1]] = True
    is_last[bounds[1:] - 1] = True
    starts[is_first], ends[is_last] = t.starts, t.ends
    starts[~is_first], ends[~is_last] = breaks + 1, breaks
    return Pieces(starts, ends, bounds[:-1], bounds[1:])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; tables past a bound are not kept."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        both = []
        for x in (_BASE, _INVERSE):
            a = np.full(max(n, _CHUNK + 1), x, dtype=np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        if n > _CHUNK + 1:
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = PLAIN) -> np.ndarray:
    """A 64-bit hash of each data[starts:ends] (ascending pieces), of its bytes and length only."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = fold.astype(np.uint64) + np.uint64(1)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        size = int(ends[to - 1] - base)
        if size > _CHUNK:  # one long piece
            out[at] = mix(np.array([_long(values, data[base : base + size]) + np.uint64(size)]))[0]
            at = to
            continue
        up, down = _power(size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def _long(values: np.ndarray, data: np.ndarray) -> np.uint64:
    """The sum that hashes() takes of one piece, chunk by chunk."""
    up, _ = _power(_CHUNK + 1)
    total = 0
    for at in range(0, len(data), _CHUNK):
        part = values[data[at : at + _CHUNK]]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return np.uint64(total & ((1 << 64) - 1))


def windows(h: np.ndarray, p: Pieces, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive pieces in a document, the piece each begins at, and windows per document."""
    counts = np.maximum(p.counts - k + 1, 0)
    if not len(h) or not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    n = len(h) - k + 1
    up, _ = _power(k + 1)
    joined = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        joined += h[j : j + n] * up[j + 1]
    first = spans(p.lo, counts)
    return mix(joined[first]), first, counts


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. (counts[0] of them), then those of starts[1], .."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def sums(values: np.ndarray, p: Pieces) -> np.ndarray:
    """The sum over each document's pieces."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[p.hi] - total[p.lo]


def code_points(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte, and in all."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def shingle_sets(t: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each document (A-Z lower-cased; a shorter text is one shingle),
    sorted within the document, and how many each has."""
    p = pieces(t, SPACES)
    h = hashes(t.data, p.starts, p.ends, LOWER)
    w, first, counts = windows(h, p, k)
    doc = np.repeat(np.arange(len(t)), counts)
    short = np.flatnonzero((p.counts > 0) & (p.counts < k))
    if len(short):
        up, _ = _power(k + 1)
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = p.counts[short] > j
            whole[has] += h[p.lo[short[has]] + j] * up[j + 1]
        w, doc = np.concatenate([w, mix(whole)]), np.concatenate([doc, short])
    order = np.lexsort((w, doc)) if len(short) else _by_doc(w, counts)
    w, doc = w[order], doc[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    return w[fresh], np.bincount(doc[fresh], minlength=len(t))


def _by_doc(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order by document, then hash, of hashes that lie document by document."""
    order = np.empty(len(w), np.int64)
    at = 0
    for n in counts.tolist():
        order[at : at + n] = np.argsort(w[at : at + n]) + at
        at += n
    return order


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from values that lie list by list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column; row i holds the next counts[i] values as they lie in memory."""
    size = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(counts)]) * size
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    raise ValueError("a batch holds more than 2 GB of binary values; pass smaller batches")
