"""Quality rules on tokeniser fertility.

Public vocabularies encode each word of a text. Characters per token, the share of byte-fallback tokens
and the entropy of the tokens tell prose in a language from noise: bands around the middle of each group
(the lang column, else the main script) hold what is usual there, and texts outside are rejected.
Entropy grows with length: it is judged by what a line over the logarithm of the token count leaves of it,
in bands per group and power of two of the token count. A group's quartiles are drawn towards those of the
level above (length class, then all texts) by PRIOR texts' weight, so every text has a band and no group
changes its rule at some size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm import text as X
from cohortlake.llm.shared import saved, ship, spread
from cohortlake.llm.tokens import PieceEncoder, encoder

REPEAT_WINDOW = 8
#: Texts of fewer words fail.
LEAST_WORDS = 20
#: Bands are this many times the distance from the median to a quartile, and this wide at least.
REACH = 4.0
SLACK = {"chars_per_token": 0.25, "fallback_share": 0.03, "entropy": 0.6}
#: Weight, in texts, of the quartiles of the level above.
PRIOR = 50
#: Band tables up to so many rows are broadcast.
BROADCAST_ROWS = 100_000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Scripts by the first byte of a UTF-8 character: rough, but each spans whole blocks.
_SCRIPTS = (("latin", X._table((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9))), ("greek", X._table((0xCD, 0xCF))), ("cyrillic", X._table((0xD0, 0xD3))), ("semitic", X._table((0xD6, 0xDB))), ("indic", X._table((0xE0, 0xE0))), ("cjk", X._table((0xE3, 0xED))))


def _over(mask: np.ndarray, t: X.Texts) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return (total[t.ends] - total[t.starts]).astype(np.int64)


def duplicate_lines(t: X.Texts, words: X.Pieces) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    lines = X.lines(t)
    full = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.ends)
    h = X.hashes(t.data, lines.starts, lines.ends)[full]
    doc = lines.doc()[full]
    distinct = np.unique(X.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(doc, minlength=len(t)) - np.bincount(doc[distinct], minlength=len(t))


def repeated_words(h: np.ndarray, p: X.Pieces, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words inside k-word windows that the text has twice or more."""
    w, first, counts = X.windows(h, p, k)
    if not len(w):
        return np.zeros(len(p.lo), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
    key = X.mix(w + doc * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, first[again], 1)
    np.add.at(edge, first[again] + k, -1)
    return X.sums(np.cumsum(edge[:-1]) > 0, p)


def _entropy(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of each document's distribution of tokens."""
    doc = np.repeat(np.arange(len(counts)), counts)
    key, n = np.unique((doc << 20) | ids, return_counts=True)
    share = n / np.maximum(counts, 1)[key >> 20]
    return -np.bincount(key >> 20, weights=share * np.log2(share), minlength=len(counts))


_MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("n_tokens", T.LongType()), ("chars_per_token", T.DoubleType()), ("chars_per_byte_token", T.DoubleType()), ("fallback_share", T.DoubleType()), ("entropy", T.DoubleType()), ("script", T.StringType())]


def _measure(text: str, pieces_file: str, bytes_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([n for n, _ in _SCRIPTS] + ["other"])
        for batch in batches:
            for part in X.portions(batch, text):
                column = part.column(text)
                t = X.texts(column)
                p = X.pieces(t, X.SPACES)
                h = X.hashes(t.data, p.starts, p.ends)
                points = X.code_points(t.data)
                chars = points[t.ends] - points[t.starts] - _over(X.SPACES[t.data], t)
                pieces = encoder(pieces_file, False, PieceEncoder)
                ids, n = pieces.encode(column, True)
                low, high = pieces.byte_ids
                fallback = _sums((ids >= low) & (ids <= high), n)
                spread = _entropy(ids.astype(np.int64), n)
                _, n_bytes = encoder(bytes_file, False).encode(column, True)
                scripts = np.stack([_over(m[t.data], t) for _, m in _SCRIPTS])
                script = np.where(scripts.max(axis=0) > 0, scripts.argmax(axis=0), len(_SCRIPTS))
                rest = [c for c in part.schema.names if c != text]
                made = [p.counts, chars, _over(_SYMBOLS[t.data], t), duplicate_lines(t, p), repeated_words(h, p), n, chars / np.maximum(n, 1), chars / np.maximum(n_bytes, 1), fallback / np.maximum(n, 1), spread]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *[pa.array(x) for x in made], pa.array(names[script].tolist(), pa.string())], names=[*rest, *[m for m, _ in _MEASURES]])

    return run


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def measure(docs: DataFrame, *, pieces_file: str, bytes_file: str, text: str = "text") -> DataFrame:
    """docs without the text, with the counts and measures of each whole text; a null text is empty."""
    ship(docs.sparkSession)
    docs = docs.drop(*[n for n, _ in _MEASURES])
    schema = T.StructType([*docs.drop(text).schema.fields, *[T.StructField(n, k) for n, k in _MEASURES]])
    return spread(docs).mapInArrow(_measure(text, pieces_file, bytes_file), schema)


_RESULTS = ("base_failed", "band", "length_class", "kept")
_OVER_GROUP = ("chars_per_token", "chars_per_byte_token", "fallback_share")


def _quartiles(sound: DataFrame, by: list[str], names: tuple[str, ...], level: str) -> DataFrame:
    """Texts and quartiles of each measure in each group; working names begin with a blank and the level."""
    quartiles = [F.percentile_approx(n, [0.25, 0.5, 0.75], 10_000).alias(f" {level}{n}") for n in names]
    return sound.groupBy(*[F.col(c).alias(f" {level}{c}") for c in by]).agg(F.count("*").alias(f" {level}n"), *quartiles)


def _drawn(n: Column, own: Column, above: list[Column]) -> list[Column]:
    """A group's quartiles drawn towards those above; those above where the group has no sound text."""
    return [F.coalesce((n * own[k] + PRIOR * x) / (n + PRIOR), x) for k, x in enumerate(above)]


def judge(measured: DataFrame, *, lang: str | None = "lang") -> DataFrame:
    """measured with base_failed, the group (band, length_class) and its verdict: kept.

    Fails by the base: fewer than 20 words, or over 30 % of the words in repeated windows. Else a text is
    kept if it lies inside its group's bands. Without any sound text there are no bands, and none is kept.
    Columns that have the names of results are replaced, others stay.
    """
    group = F.coalesce(F.col(lang).cast("string"), F.col("script")) if lang else F.col("script")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    size = F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))
    given = measured.select(*measured.columns, base.alias(" failed"), group.alias(" group")).drop(*_RESULTS)
    held = saved(given.withColumnsRenamed({" failed": "base_failed", " group": "band"}).withColumn("length_class", F.floor(size).cast("int")), "fertility")
    line = held.where(~F.col("base_failed")).agg(F.regr_slope("entropy", size).alias("slope"), F.regr_intercept("entropy", size).alias("level"), F.avg("entropy").alias("mean")).first()
    at, slope = (line["mean"], 0.0) if line["slope"] is None else (line["level"], line["slope"])
    out = held.withColumn(" rest", F.col("entropy") - F.lit(at or 0.0) - F.lit(slope) * size)
    sound = out.where(~F.col("base_failed"))
    every = sound.agg(F.count("*").alias("n"), *[F.percentile_approx(n, [0.25, 0.5, 0.75], 10_000).alias(n) for n in (*_OVER_GROUP, " rest")]).first()
    if not every["n"]:
        return held.withColumn("kept", F.lit(False))
    for by, names, level in ((["band"], _OVER_GROUP, "a"), (["length_class"], (" rest",), "b"), (["band", "length_class"], (" rest",), "c")):
        found = saved(_quartiles(sound, by, names, level), "bands")
        same = F.lit(True)
        for c in by:
            same = same & (F.col(c) == F.col(f" {level}{c}"))
        out = out.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, same, "left")
    inside = ~F.col("base_failed")
    middle = {n: _drawn(F.col(" an"), F.col(f" a{n}"), [F.lit(float(x)) for x in every[n]]) for n in _OVER_GROUP}
    middle[" rest"] = _drawn(F.col(" cn"), F.col(" c rest"), _drawn(F.col(" bn"), F.col(" b rest"), [F.lit(float(x)) for x in every[" rest"]]))
    for n, (low, mid, high) in middle.items():
        slack = F.lit(SLACK.get(n.replace(" rest", "entropy"), SLACK["chars_per_token"]))
        if n != "fallback_share":
            inside = inside & (F.col(n) >= mid - F.greatest(slack, REACH * (mid - low)))
        if n != " rest":
            inside = inside & (F.col(n) <= mid + F.greatest(slack, REACH * (high - mid)))
    return out.select(*held.columns, inside.alias("kept"))


def rate(docs: DataFrame, *, pieces_file: str, bytes_file: str, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """docs without the text, measured and judged: one row per row, repeated rows and null ids included."""
    return judge(measure(docs, pieces_file=pieces_file, bytes_file=bytes_file, text=text), lang=lang)
