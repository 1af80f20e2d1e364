"""Whole texts to token ids with the tokenizers library, each distinct chunk encoded once.

Both vocabularies pre-tokenise so that no token crosses certain white space; texts are cut there, and
the ids of a chunk are those it has in its text. Texts with white space beyond ASCII go to the library
whole. test_encoder_equals_library holds the ids against the library's own for each text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortlake.llm import text as X

#: White space that is none of \x20, \x09-\x0D.
_RARE_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Chunks whose ids a worker keeps (about 40 bytes each); at the bound it starts anew.
CACHE_CHUNKS = 1_500_000
#: Chunks encoded in one call, as one text with a special token between them.
_JOINED = 500


class Encoder:
    """file: of the tokenizers library. spaced: a byte-level vocabulary in which a blank belongs to the
    word after it; else white space yields no ids."""

    def __init__(self, file: str, spaced: bool):
        self.kind = np.uint16 if self._load(file) <= 1 << 16 else np.uint32
        self.spaced = spaced
        self._reset()

    def _load(self, file: str) -> int:
        """Opens the vocabulary; its size."""
        # a task has one core: the library's threads would only hold memory beside it
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.splitting = Tokenizer.from_file(file)
        special = {t.content: i for i, t in self.splitting.get_added_tokens_decoder().items() if t.special}
        self.reserved = list(special)
        self.mark = next(iter(special), None)
        self.mark_id = special.get(self.mark, -1)
        self.vocabulary_size = self.splitting.get_vocab_size(with_added_tokens=True)
        return self.vocabulary_size

    def _alone(self, words: list[str]) -> list[list[int]]:
        self.splitting.encode_special_tokens = True  # the strings of special tokens are ordinary text
        try:
            return [e.ids for e in self.splitting.encode_batch_fast(words, add_special_tokens=False)]
        finally:
            self.splitting.encode_special_tokens = False

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word by itself, in a row, and how many each has.

        Words are joined by a special token, at which the library splits before it does anything else.
        A word that holds such a token's string is encoded alone."""
        odd = [any(m in w for m in self.reserved) for w in words] if self.mark is not None else []
        if self.mark is None or any(odd):
            found = [np.array(ids, dtype=np.int64) for ids in self._alone(words)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        joined = [self.mark.join(words[i : i + _JOINED]) + self.mark for i in range(0, len(words), _JOINED)]
        ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in self.splitting.encode_batch_fast(joined, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(marks, prepend=-1) - 1

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, self.kind)
        self.used = 0

    def _chunks(self, t: X.Texts, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = X.pieces(t, X.SPACES)
        starts, ends = p.starts, p.ends
        if self.spaced and len(p):
            before = np.concatenate([[0], ends[:-1]])
            some = p.counts > 0
            before[p.lo[some]] = t.starts[some]
            gap = starts > before
            led = gap & (t.data[np.maximum(starts - 1, 0)] == 32)
            # what stands before a word: all but its last character; that one if it is no blank; the word
            cut = np.where(gap, starts - 1, starts)
            begin = np.where(led, starts - 1, starts)
            tails = np.where(some, ends[np.maximum(p.hi - 1, 0)], t.starts)
            starts = np.concatenate([before, cut, begin, tails])
            ends = np.concatenate([cut, begin, ends, t.ends])
        elif self.spaced:
            starts, ends = t.starts, t.ends
        if whole.any():
            doc = np.searchsorted(t.ends, starts, "right")
            keep = ~whole[np.minimum(doc, len(whole) - 1)]
            starts, ends = np.concatenate([starts[keep], t.starts[whole]]), np.concatenate([ends[keep], t.ends[whole]])
        full = starts < ends
        starts, ends = starts[full], ends[full]
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _learn(self, t: X.Texts, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = t.data.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        flat, sizes = self._encode_words(words)
        n, m = len(self.known), len(keys)
        while n + m > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + m] = sizes
        self.used += len(flat)
        # both are sorted
        at = np.searchsorted(self.known, keys)
        self.known, self.slot = np.insert(self.known, at, keys), np.insert(self.slot, at, np.arange(n, n + m, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the ids of each chunk are; -1 if it is new."""
        if not len(self.known):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.slot[at], -1)

    def encode(self, column: pa.Array, by_word: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and how many each text has. Null texts have none.

        chunk_sizes then has the ids of each chunk; unless `spaced`, chunks are the words of the texts,
        but for the texts of which `whole` is true: those are one chunk. by_word: no text is whole, and the
        words are encoded one by one, with other white space inside them."""
        t = X.texts(column)
        whole = pc.fill_null(pc.match_substring_regex(column, _RARE_SPACE), False).to_numpy(zero_copy_only=False)
        if by_word:
            whole = np.zeros(len(t), bool)
        starts, ends = self._chunks(t, whole)
        self.whole, self.chunk_sizes = whole, np.zeros(0, np.int64)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(t), np.int64)
        keys, at, back = np.unique(X.hashes(t.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_CHUNKS:
            self._reset()
        slots = self._slots(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(t, keys[new], starts[at[new]], ends[at[new]])
        sizes = self.size[slots][back].astype(np.int64)
        self.chunk_sizes = sizes
        ids = self.flat[X.spans(self.begin[slots][back], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(starts, t.ends)] - total[np.searchsorted(starts, t.starts)]

    def encode_ended(self, column: pa.Array, end: int, by_word: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with the id `end` after each text."""
        ids, counts = self.encode(column, by_word)
        return self.ended(ids, counts, end)

    def ended(self, ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts with the id `end` after each text."""
        stops = np.cumsum(counts + 1)
        out = np.full(int(stops[-1]) if len(stops) else 0, end, dtype=self.kind)
        inside = np.ones(len(out), bool)
        inside[stops - 1] = False
        out[inside] = ids
        return out, counts + 1


class PieceEncoder(Encoder):
    """The same with the sentencepiece library: the ids of each word by itself, white space left out."""

    def _load(self, file: str) -> int:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = [i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i)]
        #: The first and last id of single bytes; they lie together.
        self.byte_ids = (ids[0], ids[-1]) if ids else (1, 0)
        return self.pieces.vocab_size()

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.pieces.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes


class Slots:
    """Numbers of 64-bit keys in the order in which they came, by open addressing."""

    def __init__(self):
        self.many, self.keys, self.slots = 0, np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is new; 0 is no key."""
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == keys, self.slots[at], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.slots[at[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def _put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several keys one stays
            mine = self.keys[at] == keys
            self.slots[at[mine]] = slots[mine]
            keys, slots, at = keys[~mine], slots[~mine], (at[~mine] + 1) & mask

    def number(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, those of new keys too, and where each new key first is, in their order."""
        keys = np.maximum(keys, np.uint64(1))
        slots = self.find(keys)
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots, new
        own, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
        if 2 * (self.many + len(own)) > len(self.keys):
            full = self.keys != 0
            held = self.keys[full], self.slots[full]
            size = 1 << int(4 * (self.many + len(own)) - 1).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(*held)
        given = np.arange(self.many, self.many + len(own), dtype=np.int32)
        self._put(own, given)
        self.many += len(own)
        slots[new] = given[back]
        return slots, new[first]


class WordEncoder(Encoder):
    """Words [^\\x20\\x09-\\x0D]+ one by one, as Encoder does by word.

    With the vocabulary whose form is known (NFC, lower case, cut by the pattern below, ByteLevel), words of
    printable ASCII and the letters of Latin-1 are lower-cased, cut and spelt in bytes here, and the library only
    merges: what it does to such words before that changes nothing else, and costs most of its time."""

    _BEFORE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    _CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    _PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    _PARTS = re.compile(r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+)")
    #: Letters as ByteLevel spells their two bytes: those it does not keep are U+0100 and on, after 33 others.
    _BYTES = {chr(c): "Ã" + chr(low + 162 if low <= 0xA0 else 323 if low == 0xAD else low) for c in range(0xDF, 0x100) if c != 0xF7 for low in [c - 0x40]}

    def _load(self, file: str) -> int:
        from tokenizers import Tokenizer

        size = super()._load(file)
        with open(file, encoding="utf-8") as f:
            form = json.load(f)
        cut, model = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], form["model"]
        known = (form.get("normalizer") or {}).get("normalizers") == self._BEFORE and model.get("end_of_word_suffix") == "</w>"
        known = known and not model.get("dropout") and not any(form.get(n) for n in ("truncation", "padding", "post_processor"))
        known = known and len(cut) == 2 and cut[0] == {"type": "Split", "pattern": {"Regex": self._CUT}, "behavior": "Removed", "invert": True}
        known = known and cut[1].get("type") == "ByteLevel" and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex")
        # each character can stand last in a word, so the last id of each pre-token, and no other, is marked
        known = known and all(c in model["vocab"] and f"{c}</w>" in model["vocab"] for c in {*map(chr, range(33, 127)), *"".join(self._BYTES.values())})
        self.merging = None
        if known:
            self.merging = Tokenizer.from_str(json.dumps(form | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.closes = np.zeros(size + 1, bool)
            self.closes[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
        return size

    def _reset(self) -> None:
        super()._reset()
        self.slots = Slots()

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of plain words."""
        texts = [self._PARTS.sub(r"\1 ", "\n".join(words[i : i + _JOINED]).lower()) + "\n" for i in range(0, len(words), _JOINED)]
        for k, text in enumerate(texts):
            for c in set(text) & self._BYTES.keys():
                text = text.replace(c, self._BYTES[c])
            texts[k] = text
        ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in self.merging.encode_batch_fast(texts, add_special_tokens=False)])
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        cuts = np.cumsum(raw == 32)[raw == 10]
        stops = np.flatnonzero(self.closes[ids])[cuts - 1] + 1
        return ids, np.diff(stops, prepend=0)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.merging is None:
            return super()._encode_words(words)
        plain = np.array([self._PLAIN.fullmatch(w) is not None for w in words], bool)
        if not plain.any():
            return super()._encode_words(words)
        ids, sizes = self._merge([w for w, x in zip(words, plain.tolist(), strict=True) if x])
        if plain.all():
            return ids, sizes
        others, many = super()._encode_words([w for w, x in zip(words, plain.tolist(), strict=True) if not x])
        both = np.zeros(len(words), np.int64)
        both[plain], both[~plain] = sizes, many
        out, mine = np.empty(int(both.sum()), np.int64), np.repeat(plain, both)
        out[mine], out[~mine] = ids, others
        return out, both

    def _keys(self, t: X.Texts, p: X.Pieces, folded: np.ndarray) -> np.ndarray:
        """What words with the same ids share: hashes with A-Z lower-cased where the words' ids are told by those, else plain ones."""
        if self.merging is None:
            return X.hashes(t.data, p.starts, p.ends)
        # beside other characters, lower-casing before NFC is not the same as after it
        wide = np.flatnonzero(np.maximum.reduceat(t.data, p.starts) >= 128) if len(p) else np.zeros(0, np.int64)
        if not len(wide):
            return folded
        sizes = p.ends[wide] - p.starts[wide]
        data, at = t.data[X.spans(p.starts[wide], sizes)], np.cumsum(sizes) - sizes
        cased = np.logical_or.reduceat(X.LOWER[data] != data, at)
        keys = folded.copy()
        keys[wide[cased]] = X.hashes(data, at[cased], at[cased] + sizes[cased])
        return keys

    def encode_pieces(self, t: X.Texts, p: X.Pieces, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words p of t, and how many each text has. folded: hashes of the words with A-Z lower-cased."""
        if not len(p):
            return np.zeros(0, self.kind), np.zeros(len(t), np.int64)
        if self.slots.many > CACHE_CHUNKS:
            self._reset()
        n = self.slots.many
        slots, new = self.slots.number(self._keys(t, p, folded))
        if m := len(new):
            raw = t.data.tobytes()
            flat, sizes = self._encode_words([raw[a:b].decode("utf-8", "replace") for a, b in zip(p.starts[new].tolist(), p.ends[new].tolist(), strict=True)])
            while n + m > len(self.begin):
                self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat])
            self.flat[self.used : self.used + len(flat)] = flat
            self.begin[n : n + m], self.size[n : n + m] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(flat)
        sizes = self.size[slots].astype(np.int64)
        return self.flat[X.spans(self.begin[slots], sizes)], X.sums(sizes, p)


_encoders: dict[tuple, Encoder] = {}


def encoder(file: str, spaced: bool, kind: type[Encoder] = Encoder) -> Encoder:
    """This process's encoder for the file; its cache outlives a task."""
    key = (file, spaced, kind.__name__)
    if key not in _encoders:
        _encoders[key] = kind(file, spaced)
    return _encoders[key]
