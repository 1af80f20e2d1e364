"""Language ID with bit-sliced Bloom filters: one probe returns every language that has an n-gram.

Slot j of the filter is a bitmask of languages. An n-gram of language L sets bit L in its `probes` slots;
the AND of those slots is the set of languages that (up to false positives) contain it. A text's score
for L is the popcount of bit L over its n-grams, corrected by L's false-positive rate, which follows
from how many slots have bit L.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm import text as X
from cohortlake.llm.shared import saved, ship, spread

GRAM = 4
PROBES = 3
SLOTS = 1 << 21
#: An n-gram belongs to a language if it makes up at least this share of the language's n-grams; so no
#: language has more than 1 / MIN_SHARE of them, whatever the size of the corpus.
MIN_SHARE = 1e-5
#: .. and if it is not this many times rarer than in the language where its share is largest.
MAX_RATIO = 20.0

_BLANK = X._table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_FOLD = X.LOWER.copy()
_FOLD[_BLANK] = 32


def grams(t: X.Texts, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of byte n-grams of the padded, folded words of each text, and how many each text has.

    Non-letters of ASCII fold to one blank and A-Z to lower case. An n-gram may begin or end at a blank
    but has none inside, so a word of m bytes gives m + 3 - n n-grams, one at least.
    """
    p = X.pieces(t, _BLANK)
    sizes = p.ends - p.starts
    per = np.maximum(sizes + 3 - n, 1)
    # all padded words in a row, each with blanks up to n bytes
    room = np.maximum(sizes + 2, n)
    at = np.cumsum(room) - room
    flat = np.full(int(room.sum()), 32, dtype=np.uint8)
    flat[X.spans(at + 1, sizes)] = _FOLD[t.data[X.spans(p.starts, sizes)]]
    begin = X.spans(at, per)
    code = np.zeros(len(begin), dtype=np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | flat[begin + j]
    return code, X.sums(per, p)


def _counts(text: str, lang: str):
    """Rows (lang, gram, n) of what this task has read; grams are summed in memory, at most a few million."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            if len(parts) == 1:
                return parts[0]
            g, where = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
            return g, np.bincount(where, weights=np.concatenate([b for _, b in parts])).astype(np.int64)

        for batch in batches:
            for part in X.portions(batch, text):
                code, per = grams(X.texts(part.column(text)))
                if not len(code):
                    continue
                labels = part.column(lang).to_pylist()
                names = sorted(set(labels))
                which = np.repeat(np.array([names.index(x) for x in labels]), per)
                for k, name in enumerate(names):
                    parts = kept.setdefault(name, [])
                    parts.append(np.unique(code[which == k], return_counts=True))
                    if len(parts) >= 8:
                        kept[name] = [merged(parts)]
        for name, parts in kept.items():
            g, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return run


class LanguageFilter:
    """The bit-sliced filter: fit() from n-gram shares, predict() texts. Masks have a 64-bit word per 64 languages."""

    def __init__(self, languages: list[str], lang_index: np.ndarray, codes: np.ndarray, gram: int = GRAM, slots: int = SLOTS, probes: int = PROBES):
        self.languages, self.gram, self.slots, self.probes = languages, gram, slots, probes
        self.planes = np.zeros((max(1, -(-len(languages) // 64)), slots), dtype=np.uint64)
        where = self._where(codes)
        for k in range(len(languages)):
            mine = lang_index == k
            self.planes[k // 64][where[:, mine].ravel()] |= np.uint64(1 << (k % 64))
        filled = np.array([np.count_nonzero(self.planes[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))])
        self.false_rate = (filled / slots) ** probes

    def _where(self, codes: np.ndarray) -> np.ndarray:
        h = X.mix(codes)
        step = (h >> np.uint64(40)) | np.uint64(1)
        return np.stack([((h + np.uint64(j) * step) & np.uint64(self.slots - 1)).astype(np.int64) for j in range(self.probes)])

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram (a column) the bitmask of languages that contain it, a row per 64 languages."""
        where = self._where(codes)
        out = self.planes[:, where[0]]
        for w in where[1:]:
            out &= self.planes[:, w]
        return out

    def predict(self, t: X.Texts) -> tuple[list[str], np.ndarray]:
        """Languages and their scores; 'und' and 0 for a text without n-grams or of no known one."""
        code, per = grams(t, self.gram)
        if not self.languages:
            return ["und"] * len(t), np.zeros(len(t))
        distinct, back = np.unique(code, return_inverse=True)
        masks = self.masks(distinct)
        ends = np.cumsum(per)
        hits = np.empty((len(self.languages), len(t)))
        for k in range(len(self.languages)):
            has = (masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int64)[back]
            total = np.concatenate([[0], np.cumsum(has)])
            hits[k] = total[ends] - total[ends - per]
        f = self.false_rate[:, None]
        true = np.maximum((hits - per * f) / np.maximum(1 - f, 1e-9), 0)
        best = true.argmax(axis=0)
        share = np.clip(true.max(axis=0) / np.maximum(per, 1), 0, 1)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), per.tolist(), strict=True)], share


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE, max_ratio: float = MAX_RATIO, **shape) -> LanguageFilter:
    """Counts n-grams of every row with a text and a language; keeps the frequent ones of each language."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    counted = spread(rows).mapInArrow(_counts(text, lang), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # an n-gram's languages as one array, so neither totals nor shares need a join or a second count
    per_gram = counted.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("in"))
    per_gram = saved(per_gram, "grams")
    totals = {r["lang"]: r["n"] for r in per_gram.select(F.explode("in").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], np.zeros(0, int), np.zeros(0, np.uint64), **shape)
    known = F.create_map(*[c for x in languages for c in (F.lit(x), F.lit(float(totals[x])))])
    shares = per_gram.select("gram", F.transform("in", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] / F.element_at(known, x["lang"])).alias("share"))).alias("in"))
    shares = shares.withColumn("top", F.array_max(F.transform("in", lambda x: x["share"])))
    kept = shares.where(F.col("top") >= min_share).select("gram", F.explode(F.filter("in", lambda x: (x["share"] >= min_share) & (x["share"] * max_ratio >= F.col("top")))).alias("x"))
    got = kept.select("gram", "x.lang").toArrow()
    order = {x: k for k, x in enumerate(languages)}
    index = np.array([order[x] for x in got.column("lang").to_pylist()], dtype=int)
    return LanguageFilter(languages, index, got.column("gram").to_numpy().view(np.uint64), **shape)


def _predict(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageFilter = model.value
        for batch in batches:
            for part in X.portions(batch, text):
                column = part.column(text)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
                names, score = m.predict(X.texts(column))
                score[~letters] = 0
                names = [x if ok else "und" for x, ok in zip(names, letters.tolist(), strict=True)]
                rest = [n for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in rest], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*rest, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageFilter, *, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score (0 to 1: the share of n-grams the language has).

    'und' and 0 for a null text or one without a letter. Ties go to the alphabetically first language; a
    text of which no language has an n-gram goes there too, with score 0.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.drop(text).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return spread(docs).mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), text), schema)
