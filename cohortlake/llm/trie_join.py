"""N-gram Jaccard join by prefix trees.

Two documents link if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. The way
there loses no link:

1. Equal sets are one class; only its smallest id goes on.
2. All sets are ordered alike: shingles by hash, those of several documents last, by their counts in
   the corpus, so that the first ones of a document without near copies occur nowhere else. Counts of all
   such shingles are kept, as levels in a table of slots, so this holds at every size of the corpus. Linked sets
   share a shingle among the first n - ceil(0.8 n) + 1 of each, and their sizes differ by a quarter at
   most. Documents that share such a shingle, of sizes that near, are candidates. Of a shingle with few
   documents all pairs are, and a pair stays only if sketches of the two sets allow a link; those of a
   shingle with many documents are chained. Classes tied by either make up a candidate group.
3. A group's sets go into a trie, the group's common shingles first, so alike sets share a path. Each
   set walks the trie once: the overlap with a path is counted once for all sets below, and a subtree is
   left where the overlap and what remains cannot reach the bound. Every link is found; links are
   counted in the task, and only a spanning forest of them goes on, unless similar_pairs asks for all.
   Large groups are dealt to blocks, and pairs of blocks to tasks; in a pair of two, the sets of one walk
   the trie of the other, so each pair of sets is compared once, whatever the number of blocks.
4. Components of the links, and the sums of the counts, give the result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm import text as X
from cohortlake.llm.components import components
from cohortlake.llm.shared import partitions, saved, ship, spread

WORDS = 5
PERCENT = 80
#: Shingles in so many documents go last, the most common ones at the end. A table of a byte a slot has their
#: levels, an eighth of an octave each: SLOTS_EACH slots for one of them, MOST_LEVELS at most. Shingles that meet in
#: a slot have the level of the most common one. Levels only shape the order, so no clash can lose a link.
COMMON_LEAST = 3
SLOTS_EACH = 4
MOST_LEVELS = 1 << 26
#: Slots of the table that travel together, as a power of two.
CHUNK_BITS = 12
#: Shingles of the sets in one task; larger groups are dealt to blocks. A group of T shingles has
#: sqrt(T / BLOCK_UNIT) blocks, so that blocks and their number grow alike, until a block has BLOCK_SHINGLES.
TRIE_SHINGLES = 50_000
BLOCK_UNIT = 2_000
BLOCK_SHINGLES = 2_000_000
#: Documents of a shingle whose pairs are all held against sketches; more are chained instead.
FEW = 8
#: Bits of the filter that leaves documents outside all groups out of the shuffle of sets.
MOST_SLOTS = 1 << 27


class Trie:
    """A compressed prefix tree of sets whose members are numbered in one order."""

    def __init__(self, sets: list[tuple[int, ...]], members: list[int] | None = None, percent: int = PERCENT):
        """members: which sets the tree holds; all of them unless given."""
        self.percent = percent
        self.sets = sets
        self.parent = list(range(len(sets)))
        self.segment: list[tuple[int, ...]] = []
        self.depth: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.below: list[list[int]] = []
        self.ends: list[list[int]] = []
        self._build(sorted(range(len(sets)) if members is None else members, key=sets.__getitem__))

    def _build(self, order: list[int]) -> None:
        sets = self.sets
        todo = [(0, len(order), 0, -1)] if order else []
        while todo:
            lo, hi, depth, above = todo.pop()
            first, last = sets[order[lo]], sets[order[hi - 1]]
            to = depth
            while to < len(first) and to < len(last) and first[to] == last[to]:
                to += 1
            node = len(self.segment)
            if above >= 0:
                self.below[above].append(node)
            at = lo
            while at < hi and len(sets[order[at]]) == to:
                at += 1
            sizes = [len(sets[k]) for k in order[lo:hi]]
            self.segment.append(first[depth:to])
            self.depth.append(to)
            self.low.append(min(sizes))
            self.high.append(max(sizes))
            self.below.append([])
            self.ends.append(order[lo:at])
            while at < hi:
                head, start = sets[order[at]][to], at
                while at < hi and sets[order[at]][to] == head:
                    at += 1
                todo.append((start, at, to, node))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def all_links(self, q: int) -> list[int]:
        """All sets in the tree that link with set q."""
        out: list[int] = []
        if not self.segment:
            return out
        per, full, mine = self.percent, 100 + self.percent, self.sets[q]
        own, n = set(mine), len(mine)
        todo = [(0, 0)]
        while todo:
            node, shared = todo.pop()
            low, high = self.low[node], self.high[node]
            if 100 * high < per * n or per * low > 100 * n:
                continue
            seg = self.segment[node]
            if seg:
                shared += len(own.intersection(seg))
                left = n - bisect_right(mine, seg[-1])
            else:
                left = n
            least = max(low, -(-per * n // 100))
            if full * (shared + min(left, high - self.depth[node])) < per * (n + least):
                continue
            for k in self.ends[node]:
                if k != q and full * shared >= per * (n + len(self.sets[k])):
                    out.append(k)
            for c in self.below[node]:
                todo.append((c, shared))
        return out

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were in two components, which are one now."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _trie(sets: list[np.ndarray], members: list[int] | None) -> Trie:
    flat, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.lexsort((flat, -counts))] = np.arange(len(flat))
    numbered = np.split(rank[back], np.cumsum([len(s) for s in sets])[:-1])
    return Trie([tuple(np.sort(x).tolist()) for x in numbered], members)


def _fingerprint(w: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of a hash: `bits` for the bucket, 32 within it."""
    return w >> np.uint64(32 - bits)


def _print_shingles(text: str, bits: int):
    """Fingerprints of the documents' shingles, 32 bits in each of 2 to the bits buckets, and how many
    documents have each, 255 at most from one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.portions(batch, text, 4 << 20):
                w, n = np.unique(_fingerprint(X.shingle_sets(X.texts(part.column(text)), WORDS)[0], bits), return_counts=True)
                bounds = np.searchsorted(w, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
                per = np.diff(bounds)
                full = np.flatnonzero(per)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), X.binaries(w.astype(np.uint32), per[full]), X.binaries(np.minimum(n, 255).astype(np.uint8), per[full])], names=["bucket", "prints", "counts"])

    return run


def _count_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints that occur in COMMON_LEAST documents or more."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for b, prints, counts in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            held.setdefault(b, []).append((np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint8)))
    for b in list(held):
        parts = held.pop(b)
        keys, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.argsort(keys)
        keys, total = keys[order], np.concatenate([[0], np.cumsum(n[order].astype(np.int64))])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        n = np.diff(total[np.append(first, len(keys))])
        top = n >= COMMON_LEAST
        yield pa.RecordBatch.from_arrays([pa.array(((np.int64(b) << 32) | keys[first[top]].astype(np.int64))), pa.array(n[top])], names=["shingle", "n"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the slots, chunk by chunk; a task has all rows of its chunks."""
    rows = [(b.column("slot").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if rows:
        slot, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        chunk, at = np.unique(slot >> CHUNK_BITS, return_inverse=True)
        levels = np.zeros((len(chunk), 1 << CHUNK_BITS), np.uint8)
        np.maximum.at(levels, (at, slot & ((1 << CHUNK_BITS) - 1)), np.minimum(8 * np.log2(n), 255).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(chunk), X.binaries(levels.ravel(), np.full(len(chunk), 1 << CHUNK_BITS))], names=["chunk", "levels"])


def _levels(counted: DataFrame, bits: int) -> np.ndarray:
    """The level of each slot, 0 for those of no common shingle; a shingle's slot is the leading bits of its hash."""
    slot_bits = max(CHUNK_BITS, min(MOST_LEVELS, SLOTS_EACH * counted.count()).bit_length() - 1)
    slots = counted.select(F.shiftright("shingle", 32 + bits - slot_bits).alias("slot"), "n")
    dealt = slots.repartition(partitions(counted.sparkSession), F.shiftright("slot", CHUNK_BITS))
    found = dealt.mapInArrow(_chunks, "chunk long, levels binary").toArrow()
    out = np.zeros((1 << (slot_bits - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for chunk, raw in zip(found.column("chunk").to_pylist(), found.column("levels"), strict=True):
        out[chunk] = np.frombuffer(raw.as_buffer(), np.uint8)
    return out.ravel()


def _class(w: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two hashes of each set."""
    ends, mixed = np.cumsum(n), X.mix(w)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mixed, X.mix(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
    return tuple(pa.array((x[ends] - x[ends - n]).view(np.int64)) for x in sums)


def _sketches(w: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each set the parity of its members in n to 2 n slots (a power of two, 64 at least), as little-endian bits."""
    bits = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)))
    begin = np.cumsum(bits) - bits
    slot = np.repeat(begin, n) + (w & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    return X.binaries(np.packbits((np.bincount(slot, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little"), bits // 8)


def may_link(n: int, one: bytes, m: int, two: bytes) -> bool:
    """Whether sets of n and m members may link: their sketches differ in as many bits at most as the sets in members."""
    if len(one) > len(two):
        one, two = two, one
    a, b = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    size = 8 * len(two)
    while size > 8 * len(one):  # the halves of a sketch give that of half the slots
        size //= 2
        b = (b ^ (b >> size)) & ((1 << size) - 1)
    return (a ^ b).bit_count() <= n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT))


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose sets may link."""
    for batch in batches:
        rows = zip(*[batch.column(k).to_pylist() for k in ("n_u", "sketch_u", "n_v", "sketch_v")], strict=True)
        yield batch.select(["u", "v"]).filter(pa.array([may_link(*row) for row in rows], pa.bool_()))


def _prefixes(common, text: str):
    """Each document's size, class (two hashes of its set), leading shingles in the common order, and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = common.value
        shift = np.uint64(64 - (len(levels).bit_length() - 1))
        for batch in batches:
            for part in X.portions(batch, text):
                w, n = X.shingle_sets(X.texts(part.column(text)), WORDS)
                doc = np.repeat(np.arange(len(n)), n)
                ends = np.cumsum(n)
                hash_a, hash_b = _class(w, n)
                sketch = _sketches(w, n)
                one, two = (x.to_numpy().view(np.uint64) for x in (hash_a, hash_b))
                w = w[np.argsort((doc << 8) | levels[w >> shift], kind="stable")]
                lead = np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)
                first = w[X.spans(ends - n, lead)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), hash_a, hash_b, X.binaries(first, lead), X.binaries(X.mix(one + X.mix(two)), np.ones(len(n), np.int64)), sketch], names=["doc_id", "n", "hash_a", "hash_b", "lead", "whole", "sketch"])

    return run


def _runs(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where runs begin, of ranges sorted by key and low: a run has one key and no gap in sizes too wide to link."""
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    step = int(high.max()) + 1
    top = np.maximum.accumulate(high + group * step) - group * step
    begins = np.ones(len(key), bool)
    begins[1:] = (key[1:] != key[:-1]) | (100 * top[:-1] < PERCENT * low[1:])
    return np.flatnonzero(begins)


def _distinct(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    other = u != v
    return np.unique(np.stack([u[other], v[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)


def _stars(key: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, one: np.ndarray, few: int):
    """Of rows (a document of size low, or several chained to doc where not `one`): runs of at most `few` documents as
    their rows, larger ones chained as (key, smallest id, low, high, one); distinct edges from their ids to the smallest;
    and distinct pairs (larger id, smaller id) of the documents in a small run whose sizes allow a link."""
    order = np.lexsort((low, key))
    key, doc, low, high, one = key[order], doc[order], low[order], high[order], one[order]
    at = _runs(key, low, high)
    size = np.diff(np.concatenate([at, [len(key)]]))
    small = (size <= few) & np.logical_and.reduceat(one, at)
    here, run = np.repeat(small, size), np.repeat(np.arange(len(at)), size)
    hub = np.minimum.reduceat(doc, at)
    edges = _distinct(doc[~here], hub[run[~here]])
    key_, doc_, low_, run = key[here], doc[here], low[here], run[here]
    found = [np.zeros((2, 0), np.int64)]
    for step in range(1, few):
        a, b = doc_[:-step], doc_[step:]
        near = (run[:-step] == run[step:]) & (100 * low_[:-step] >= PERCENT * low_[step:])
        found.append(np.stack([np.maximum(a, b)[near], np.minimum(a, b)[near]]))
    pairs = _distinct(*np.concatenate(found, axis=1))
    many = ~small
    chained = (key[at][many], hub[many], np.minimum.reduceat(low, at)[many], np.maximum.reduceat(high, at)[many])
    rows = [np.concatenate(x) for x in zip((key_, doc_, low_, low_), chained, strict=True)]
    return (*rows, np.arange(len(rows[0])) < len(key_)), edges, pairs


def _arrays(batch: pa.RecordBatch, name: str, kind=np.int64) -> np.ndarray:
    t = X.texts(batch.column(name).cast(pa.large_binary()).view(pa.large_string()))
    return np.ascontiguousarray(t.data).view(kind)


_POSTED = "bucket int, keys binary, hubs binary, lows binary, highs binary"


def _chosen(bits: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose slot is marked."""
    slot = batch.column("slot").to_numpy()
    return batch.filter(pa.array(bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1) == 1))


def _post(buckets: int, column: str, few: int, chosen=None):
    """Postings of the keys in a column, dealt to buckets by shingle. Runs of more than `few` documents are merged within
    the task: one posting per shingle and run of sizes, its low negated. Edges found here travel along, with bucket -1 - b
    and no keys. chosen: slots of the documents to post; all unless given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            batch = _chosen(chosen.value, batch) if chosen else batch
            per = np.array([len(x) // 8 for x in batch.column(column).to_pylist()], np.int64)
            keys.append(_arrays(batch, column, np.uint64))
            docs.append(np.repeat(batch.column("doc_id").to_numpy(), per))
            sizes.append(np.repeat(batch.column("n").to_numpy(), per))
        key, doc, size = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes)
        if not len(key):
            return
        (key, hub, low, high, one), edges, _ = _stars(key, doc, size, size, np.ones(len(key), bool), few)
        where = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hub, where))
        key, hub, where, span = key[order], hub[order], where[order], (high - low)[order].astype(np.int32)
        low = np.where(one, low, -low)[order].astype(np.int32)
        bounds = np.searchsorted(where, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(bounds))
        count = np.diff(bounds)[full]
        for a in range(0, len(full), 64):
            rows = full[a : a + 64]
            own = slice(bounds[rows[0]], bounds[rows[-1] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[X.binaries(x[own], count[a : a + 64]) for x in (key, hub, low, span)]], names=["bucket", "keys", "hubs", "lows", "highs"])
        if edges.shape[1]:
            none = pa.array([b""], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(edges[0, 0]) % buckets], pa.int32()), X.binaries(edges[1], np.array([edges.shape[1]])), X.binaries(edges[0], np.array([edges.shape[1]])), none, none], names=["bucket", "keys", "hubs", "lows", "highs"])

    return run


def _edges(found: np.ndarray, sure: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(np.full(found.shape[1], sure))], names=["u", "v", "sure"])


def _meet(few: int):
    """Edges (u, v): those that travelled along, those that chain runs of one shingle, and, not sure, the pairs of small runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            ready = pc.less(batch.column("bucket"), 0)
            done = batch.filter(ready)
            if done.num_rows:
                yield _edges(np.stack([_arrays(done, "hubs"), _arrays(done, "keys")]), True)
            rest = batch.filter(pc.invert(ready))
            for part, (name, kind) in zip(parts, (("keys", np.uint64), ("hubs", np.int64), ("lows", np.int32), ("highs", np.int32)), strict=True):
                part.append(_arrays(rest, name, kind))
        if not parts[0]:
            return
        key, hub, low, span = (np.concatenate(p) for p in parts)
        if not len(key):
            return
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if again.any():
            one, least = low[again] > 0, np.abs(low[again]).astype(np.int64)
            _, edges, pairs = _stars(key[again], hub[again], least, least + span[again], one, few)
            yield _edges(edges, True)
            yield _edges(pairs, False)

    return run


def _sets(chosen, text: str):
    """The sets of documents whose slot is marked, with their classes: all candidates, and others by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.portions(_chosen(chosen.value, batch), text):
                w, n = X.shingle_sets(X.texts(part.column(text)), WORDS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_class(w, n), X.binaries(w, n)], names=["doc_id", "hash_a", "hash_b", "members"])

    return run


def _marked(ids: DataFrame, slots: int) -> np.ndarray:
    """A bitmap of the ids' slots: slots / 8 bytes, however many ids there are."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    rows = ids.groupBy(F.call_function("div", slot, F.lit(64)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {slots}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(slots // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


_LINKS = "u long, v long, hash_a long, hash_b long, links long"


def _join_groups(pairs: bool):
    """Within each group of rows (sorted by group_id, block_a, block_b, doc_id, hash_a, hash_b): links (u, v) of a
    spanning forest, or all `pairs`; and how many documents each class (u, hash_a, hash_b; v is null) links with.

    A task has the sets of one block, or those of two, of which it joins only sets of different blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, rows, sets = None, None, [], []

        def done() -> pa.RecordBatch:
            out, counts = [], [0] * len(rows)
            _, a, b = now
            asked = [q for q, row in enumerate(rows) if row[4] == a]
            members = None if a == b else [k for k, row in enumerate(rows) if row[4] == b]
            trie = _trie(sets, members)
            for q in asked:
                for k in trie.all_links(q):
                    counts[q] += rows[k][3]
                    if a != b:
                        counts[k] += rows[q][3]
                    if (a != b or q < k) if pairs else trie.join(q, k):
                        out.append((rows[q][0], rows[k][0], None, None, 0))
            out += [(doc, None, one, two, n) for (doc, one, two, _, _), n in zip(rows, counts, strict=True) if n]
            columns = zip(*out, strict=True) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["u", "v", "hash_a", "hash_b", "links"])

        for batch in batches:
            for g, a, b, *row, raw in zip(*[batch.column(n).to_pylist() for n in ("group_id", "block_a", "block_b", "doc_id", "hash_a", "hash_b", "copies", "own", "members")], strict=True):
                if now != (g, a, b):
                    if len(rows) > 1:
                        yield done()
                    now, last, rows, sets = (g, a, b), None, [], []
                if row != last:  # rows of one id and one set are one
                    last = row
                    rows.append(row)
                    sets.append(np.frombuffer(raw, np.uint64))
        if len(rows) > 1:
            yield done()

    return run


def similar_pairs(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", trie_shingles: int = TRIE_SHINGLES) -> DataFrame:
    """(u, v): all links between classes of equal sets, each by its smallest id; similar_groups() has each
    document's class. As many rows as links: their number grows with the square of a group's classes."""
    _, _, _, links = _linked(docs, text, doc_id, trie_shingles, True)
    return links.where("v IS NOT NULL").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def similar_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", trie_shingles: int = TRIE_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links), one row for each row of docs.

    doc_id is cast to long. Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased. A text of fewer than five words is one
    shingle; null texts and those without words have none and link with nothing. Rows of one id are one
    node, with a set for each text. Rows without an id link with nothing; their component_id is null.
    class_id is the smallest id with an equal set, n_links the number of other rows with an id whose sets
    link with the row's own, equal ones too.
    """
    leads, classes, equal, links = _linked(docs, text, doc_id, trie_shingles, False)
    found = saved(components(links.where("v IS NOT NULL").select("u", "v").unionByName(equal)), "linked")
    counted = links.where("v IS NULL").groupBy(F.col("u").alias("class_id"), "hash_a", "hash_b").agg(F.sum("links").alias("links"))
    known = classes.withColumnRenamed("v", "class_id").join(counted, ["class_id", "hash_a", "hash_b"], "left")
    known = known.select("hash_a", "hash_b", "n", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).where("n_links > 0")
    rows = leads.select("doc_id", "n", "hash_a", "hash_b").join(known.hint("merge"), ["hash_a", "hash_b", "n"], "left")
    has = F.col("doc_id").isNotNull()
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "class_id", "n_links")


def _linked(docs: DataFrame, text: str, doc_id: str, trie_shingles: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their sets' sizes and hashes, classes, edges between equal sets, and what _join_groups() gives."""
    spark = docs.sparkSession
    ship(spark)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    bits = min(16, max(8, (4 * partitions(spark) - 1).bit_length()))
    printed = rows.select("text").mapInArrow(_print_shingles("text", bits), "bucket int, prints binary, counts binary").repartition(partitions(spark), "bucket")
    counted = saved(printed.mapInArrow(_count_prints, "shingle long, n long"), "common-shingles")
    common = spark.sparkContext.broadcast(_levels(counted, bits))
    leads = saved(rows.mapInArrow(_prefixes(common, "text"), "doc_id long, n long, hash_a long, hash_b long, lead binary, whole binary, sketch binary"), "leads")

    sized = leads.where("n > 0 AND doc_id IS NOT NULL")
    same = ["hash_a", "hash_b", "n"]
    classes = saved(sized.groupBy(*same).agg(F.min("doc_id").alias("v"), F.count("*").alias("copies")), "classes")
    buckets = 4 * partitions(spark)

    def marked(ids: DataFrame):
        slots = min(MOST_SLOTS, 1 << max(20, int(16 * ids.count()).bit_length()))
        return F.pmod(F.xxhash64("doc_id"), F.lit(slots)), spark.sparkContext.broadcast(_marked(ids, slots))

    def edges(column: str, few: int, slot=F.lit(0), chosen=None) -> DataFrame:
        posted = sized.select("doc_id", "n", column, slot.alias("slot")).mapInArrow(_post(buckets, column, few, chosen), _POSTED)
        return posted.repartition(partitions(spark), "bucket").mapInArrow(_meet(few), "u long, v long, sure boolean")

    equal = saved(edges("whole", 1).select("u", "v").distinct(), "equal-sets")
    # the smallest id of each class stands for all; others by chance, where slots clash
    near = saved(edges("lead", FEW, *marked(classes.select(F.col("v").alias("doc_id")))), "candidates")
    sketched = lambda end: sized.select(F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
    asked = near.where("NOT sure").select("u", "v").distinct().join(sketched("u").hint("merge"), "u").join(sketched("v").hint("merge"), "v")
    allowed = asked.mapInArrow(_allowed, "u long, v long")
    groups = components(near.where("sure").select("u", "v").unionByName(allowed).unionByName(equal))

    # one member of each class goes on, in groups of two classes or more
    firsts = classes.select(F.col("v").alias("doc_id"), "n").groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
    members = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id")).join(firsts, "doc_id")
    sizes = members.groupBy("group_id").agg(F.sum("n").alias("total"), F.sum("sets").alias("sets")).where("sets > 1")
    most = F.greatest(F.ceil(F.sqrt(F.col("total") / (trie_shingles * BLOCK_UNIT / TRIE_SHINGLES))), F.ceil(F.col("total") / BLOCK_SHINGLES))
    work = saved(members.join(sizes.select("group_id", F.when(F.col("total") > trie_shingles, most).otherwise(1).cast("int").alias("blocks")), "group_id").join(classes.drop("n").withColumnRenamed("v", "doc_id"), "doc_id").select("doc_id", "hash_a", "hash_b", "copies", "group_id", "blocks"), "trie-members")
    slot, chosen = marked(work)
    slotted = rows.where("doc_id IS NOT NULL").withColumn("slot", slot)
    # sets, not texts, are shuffled, and by a merge join at every size
    sets = slotted.mapInArrow(_sets(chosen, "text"), "doc_id long, hash_a long, hash_b long, members binary").join(work.hint("merge"), ["doc_id", "hash_a", "hash_b"])
    # block k meets each block j, itself too: as the pair (min, max)
    own = F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")
    dealt = sets.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high, n = F.least("own", "other"), F.greatest("own", "other"), partitions(spark)
    # a group's pairs of blocks go to partitions in turn: by a hash several would meet in one
    to = F.pmod(F.xxhash64("group_id") + low * F.col("blocks") + high, F.lit(n)).cast("int")
    dealt = dealt.select("doc_id", "hash_a", "hash_b", "copies", "own", "group_id", low.alias("block_a"), high.alias("block_b"), to.alias("to"), "members")
    tasks = ["group_id", "block_a", "block_b"]
    links = dealt.repartitionById(n, "to").drop("to").sortWithinPartitions(*tasks, "doc_id", "hash_a", "hash_b").mapInArrow(_join_groups(pairs), _LINKS)
    return leads, classes, equal, saved(links, "links")
