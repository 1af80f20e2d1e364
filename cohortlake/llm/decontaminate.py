"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

The automaton holds every word sequence of every item. Documents stream through it word by word; the
state carries the length of the longest suffix of the text that occurs in an item. A length of `window`
(or a whole shorter item) marks those words as hit. Only runs of words that all occur in some item are
streamed: outside them the matched length is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm import text as X
from cohortlake.llm.shared import ship, spread

WINDOW = 10
#: Words of items in one automaton; a larger benchmark is dealt to several, used one after the other.
BLOCK_WORDS = 200_000
#: A document keeps what lies outside its hits if they are at most this share of its words.
MAX_COVERAGE = 0.5


class SuffixAutomaton:
    """All word sequences of the items, with the items in which each window occurs."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = self._encode(items)
        for _, ids in sequences:
            last = 0
            for x in ids:
                last = self._extend(last, x)
        self.full: dict[int, set[str | None]] = {}
        self.whole: dict[int, list[tuple[int, str | None]]] = {}
        self.least = min((min(window, len(ids)) for _, ids in sequences), default=window)
        for name, ids in sequences:
            self._mark(name, ids)
        self.above = self._nearest_marked()

    def _encode(self, items: Iterable[tuple[str | None, str | None]]) -> list[tuple[str | None, list[int]]]:
        names, bodies = [], []
        for name, body in items:
            names.append(name)
            bodies.append(body)
        t = X.texts(pa.array(bodies, type=pa.string()))
        p = X.pieces(t, X.NOT_ALNUM)
        h = X.hashes(t.data, p.starts, p.ends, X.LOWER)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        return [(n, ids[a:b].tolist()) for n, a, b in zip(names, p.lo, p.hi, strict=True) if b > a]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, x: int) -> int:
        """The state of exactly length[p]+1 words reached from p by x."""
        q = self.next[p][x]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x)
        return new

    def _mark(self, name: str | None, ids: list[int]) -> None:
        if len(ids) < self.window:
            at = 0
            for x in ids:
                at = self.next[at][x]
            self.whole.setdefault(at, []).append((len(ids), name))
            return
        for at, n in self.stream(ids):
            if n >= self.window:
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                self.full.setdefault(at, set()).add(name)

    def _nearest_marked(self) -> list[int]:
        """For each state the nearest proper suffix state where a short item ends, or -1."""
        above = [-1] * len(self.link)
        for at in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[at]
            above[at] = up if up in self.whole else above[up]
        return above

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """After each word the state and the longest matching length."""
        at = n = 0
        edges, link, length = self.next, self.link, self.length
        for x in ids:
            to = edges[at].get(x)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = edges[at].get(x)
            if to is None:
                n = 0
            else:
                at, n = to, n + 1
            yield at, n

    def scan(self, ids: list[int], base: int, hits: list[tuple[int, int]], seen: set[tuple[int, int]]) -> None:
        """Adds the hit spans [from, to), and the states and lengths of items that end in ids; base is the index of ids[0]."""
        window, link, length, full, whole, above = self.window, self.link, self.length, self.full, self.whole, self.above
        for i, (at, n) in enumerate(self.stream(ids), base + 1):
            size = 0
            if n >= window:
                size, top = window, at
                while length[link[top]] >= window:
                    top = link[top]
                if top in full:
                    seen.add((top, window))
            mark = at
            while mark >= 0:
                for k, _ in whole.get(mark, ()):
                    if k <= n:
                        size = max(size, k)
                        seen.add((mark, k))
                mark = above[mark]
            if size:
                begin = i - size
                while hits and hits[-1][1] >= begin:
                    begin = min(begin, hits.pop()[0])
                hits.append((begin, i))

    def names(self, seen: set[tuple[int, int]]) -> set[str | None]:
        """The items of what scan() has seen; each state's set is merged once, however often it was met."""
        out: set[str | None] = set()
        for at, k in seen:
            if k >= self.window:
                out |= self.full[at]
            else:
                out.update(name for size, name in self.whole[at] if size == k)
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _in_order(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def _scan_batches(automata: list, text: str, keep: bool):
    """Adds to each row its hits by all automata: n_words, hit_words (from, to in words), item_ids.

    A worker holds one automaton at a time: where there are several, each is loaded for a batch and dropped."""

    def scanned(a: SuffixAutomaton, p: X.Pieces, h: np.ndarray) -> dict[int, tuple[list, set]]:
        if not len(a.vocabulary) or not len(p):
            return {}
        ids = np.searchsorted(a.vocabulary, h)
        ids[ids == len(a.vocabulary)] = 0
        known = a.vocabulary[ids] == h
        edge = np.zeros(len(h) + 1, bool)
        edge[p.lo], edge[p.hi] = True, True
        before = np.concatenate([[False], known[:-1]])
        after = np.concatenate([known[1:], [False]])
        begins = np.flatnonzero(known & (~before | edge[:-1]))
        ends = np.flatnonzero(known & (~after | edge[1:])) + 1
        long = ends - begins >= a.least
        begins, ends = begins[long], ends[long]
        docs = np.searchsorted(p.hi, begins, "right")
        found: dict[int, tuple[list, set]] = {}
        for d, b, e in zip(docs.tolist(), begins.tolist(), ends.tolist(), strict=True):
            spans, seen = found.setdefault(d, ([], set()))
            a.scan(ids[b:e].tolist(), int(b - p.lo[d]), spans, seen)
        return {d: (spans, a.names(seen)) for d, (spans, seen) in found.items() if spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, words = list(X.portions(batch, text)), []
            for part in parts:
                t = X.texts(part.column(text))
                p = X.pieces(t, X.NOT_ALNUM)
                words.append((p, X.hashes(t.data, p.starts, p.ends, X.LOWER)))
            hits: list[dict[int, tuple[list, set]]] = [{} for _ in parts]
            for shared in automata:
                a: SuffixAutomaton = shared.value
                for (p, h), held in zip(words, hits, strict=True):
                    for d, (spans, names) in scanned(a, p, h).items():
                        old = held.get(d, ([], set()))
                        held[d] = _merged(old[0] + spans), old[1] | names
                del a
                if len(automata) > 1:
                    vars(shared).pop("_value", None)
            for part, (p, _), held in zip(parts, words, hits, strict=True):
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                spans = [[{"from": x, "to": y} for x, y in held[d][0]] if d in held else [] for d in range(part.num_rows)]
                items = [_in_order(held[d][1]) if d in held else [] for d in range(part.num_rows)]
                rest = part if keep else part.select([n for n in part.schema.names if n != text])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p.counts, pa.int64()), pa.array(spans, type=kind), pa.array(items, type=pa.list_(pa.string()))], names=[*rest.schema.names, *_ADDED])

    return run


_ADDED = ("n_words", "hit_words", "item_ids")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """docs with n_words, hit_words (spans of words, ends excluded) and item_ids (strings, sorted).

    Null or wordless texts have no words and no hits; null or wordless items occur nowhere; rows of a
    repeated item_id count as one item, and so do those without an id, which is null, at the end. Columns of docs
    that have the names of results are replaced. The benchmark is dealt to automata of about block_words words,
    each a bounded broadcast; one pass over the texts uses them one after the other, so the benchmark's size
    is not limited. keep_text=False leaves out the text.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*_ADDED)
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).cast("string").alias("body"))
    # each separator byte ends a word at most, so this is a bound that needs no Python
    words = items.select(F.sum(F.size(F.split(F.coalesce("body", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-words // block_words))
    automata = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == k).collect()
        automata.append(docs.sparkSession.sparkContext.broadcast(SuffixAutomaton([(r["name"], r["body"]) for r in rows], window)))
    left = docs if keep_text else docs.drop(text)
    schema = T.StructType([*left.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    return spread(docs).mapInArrow(_scan_batches(automata, text, keep_text), schema)


def n_hit() -> Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])


def _cut(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.portions(batch, text):
                column, spans = part.column(text), part.column("hit_words").to_pylist()
                hit = np.array([bool(s) for s in spans])
                if hit.any():
                    t = X.texts(column)
                    p = X.pieces(t, X.NOT_ALNUM)
                    new = column.to_pylist()
                    for d in np.flatnonzero(hit).tolist():
                        raw, at, kept = t.raw(d), 0, []
                        for s in spans[d]:
                            kept.append(raw[at : p.starts[p.lo[d] + s["from"]] - t.starts[d]])
                            at = p.ends[p.lo[d] + s["to"] - 1] - t.starts[d]
                        new[d] = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
                    column = pa.array(new, type=pa.string())
                yield pa.RecordBatch.from_arrays([column if n == text else part.column(n) for n in part.schema.names], names=part.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """docs without contamination: hit spans are cut from the texts; documents of which hits cover more
    than max_coverage of the words go. Adds the columns of find_overlaps; other rows keep their text."""
    found = find_overlaps(docs, benchmark, text=text, **options).where(n_hit() <= F.lit(max_coverage) * F.col("n_words"))
    return found.mapInArrow(_cut(text), found.schema)
