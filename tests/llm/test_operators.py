"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashes."""

import collections
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cohortlake.llm import attention_lm, components, decontaminate, fertility, langid, line_dedup, packing, quality_em, shared, token_files, trie_join, url_lists
from cohortlake.llm import text as X
from cohortlake.llm.tokens import Encoder, WordEncoder

SPACES = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
TEXTS = [BASE, BASE, BASE.replace(VOCABULARY[0], "changed"), prose(200), None, "", "   \n\t ", "one two", "one two", "ÀÉ  x y\n\n z", prose(60) + "\n" + BASE + "\n" + prose(30), "\n".join([prose(30)] * 3), prose(20_000), "A B\x0bC\x00D", "<|endoftext|> plain", "日本語 テキスト"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType())])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "xx", "clash", None) for k, t in enumerate(TEXTS)] + [(None, BASE, None, "clash", None), (3, TEXTS[3], "xx", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    return re.findall(SPACES, (t or "").translate(LOWER) if lower else t or "")


# kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té漢\x0b", max_size=40)), max_size=8))
def test_kernels(texts):
    t = X.texts(pa.array(texts, pa.string()))
    p = X.pieces(t, X.SPACES)
    got = [[t.data[a:b].tobytes().decode() for a, b in zip(p.starts[lo:hi], p.ends[lo:hi], strict=True)] for lo, hi in zip(p.lo, p.hi, strict=True)]
    assert got == [words(x) for x in texts]
    lines = X.lines(t)
    got = [[t.data[a:b].tobytes().decode() for a, b in zip(lines.starts[lo:hi], lines.ends[lo:hi], strict=True)] for lo, hi in zip(lines.lo, lines.hi, strict=True)]
    assert got == [(x or "").split("\n") for x in texts]
    h = X.hashes(t.data, p.starts, p.ends, X.LOWER)
    flat = [w for x in texts for w in words(x, True)]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    sets, n = X.shingle_sets(t, 3)
    want = [len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0 for w in (words(x, True) for x in texts)]
    assert n.tolist() == want and len(sets) == sum(want)


def test_hashes_of_long_pieces_keep_no_long_tables():
    r = np.random.default_rng(1)
    data = r.integers(97, 123, 3 * X._CHUNK + 77).astype(np.uint8)
    twice = np.concatenate([data, np.array([32], np.uint8), data, np.array([32, 97, 98], np.uint8)])
    n = len(data)
    h = X.hashes(twice, np.array([0, n + 1, 2 * n + 2]), np.array([n, 2 * n + 1, 2 * n + 4]))
    assert h[0] == h[1] != h[2] and len(X._powers[0]) == X._CHUNK + 1
    short = X.hashes(np.array([97, 98], np.uint8), np.array([0]), np.array([2]))
    changed = twice.copy()
    changed[n - 1] += 1
    assert h[2] == short[0] and X.hashes(changed, np.array([0]), np.array([n]))[0] != h[0]
    p = X.Pieces(np.arange(n - 1), np.arange(1, n), np.array([0]), np.array([n - 1]))
    assert len(X.windows(X.hashes(data, p.starts, p.ends), p, 3)[0]) == n - 3 and len(X._powers[0]) == X._CHUNK + 1


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, spaced):
    file = public_tokenizers.path(name)
    whole = Tokenizer.from_file(file)
    whole.encode_special_tokens = True
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice(" \n\t'ab1!é 漢\r") for _ in range(r.randint(0, 30))) for _ in range(400)] + ["it's we'll <|startoftext|>x", "x<|endoftext|>"]
    ids, n = Encoder(file, spaced).encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


# 1


def test_quality(spark, docs, empty, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough documents of both kinds to tell
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_em.fit(real)
    rows = quality_em.classify(real, model).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.97
    assert np.mean([not r["kept"] for r in rows if r["quality"] == 0]) > 0.7
    out = quality_em.classify(docs, model, keep_text=False)
    assert out.count() == docs.count() and out.schema["kept"].dataType == T.BooleanType()
    assert quality_em.classify(empty, quality_em.fit(empty)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    r, m = np.random.default_rng(0), len(quality_em.LABELLERS)
    good, bad_rate = r.random(20_000) < 0.8, np.stack([r.uniform(0.4, 0.9, m), r.uniform(0.01, 0.1, m)])
    votes = np.where(r.random((m, 20_000)) < 0.3, quality_em.NONE, np.where(r.random((m, 20_000)) < bad_rate[good.astype(int)].T, quality_em.BAD, quality_em.GOOD))
    pattern, count = np.unique(quality_em.patterns(votes), return_counts=True)
    model = quality_em.fit_labels(pattern, count)
    assert abs(model.prior - good.mean()) < 0.02 and np.abs(model.bad - bad_rate).max() < 0.06


def plain_statistics(text):
    """The labellers' statistics of one text, character by character."""
    kind = lambda c: unicodedata.category(c)
    w, t = words(text), text or ""
    letters, body = sum(kind(c)[0] in "LM" for c in t), sum(map(len, w))
    symbols, lines = set("#*$%&|<>=~^{}[]\\"), t.split("\n")
    wide = sum(any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF))) for c in t)
    n = max(len(w) + wide / 2, 1)
    seen, twice = set(), 0
    for line in lines:
        if words(line):
            twice += line in seen
            seen.add(line)
    return [
        sum(c in symbols for c in t) / max(body, 1),
        sum(bool(set(x) & symbols) for x in w) / n,
        sum(kind(c) == "Lu" for c in t) / max(letters, 1),
        sum(c in "!！" for c in t) / n,
        len({x.translate(LOWER) for x in w}) / max(len(w), 1) * max(len(w) / 200, 1) ** 0.15,
        twice / len(lines),
        sum(not any(kind(c)[0] in "LM" for c in x) for x in w) / n,
        letters / max(body, 1),
        sum(kind(c) == "Nd" for c in t) / max(body, 1),
        sum(c in ".?。？؟।۔" for c in t) / n,
        abs(body / n - (2 if wide > body / 2 else 6)),
    ]


def test_quality_equals_a_plain_version(spark, docs, sf_dir):
    model = quality_em.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    checked = 0
    for r in quality_em.classify(docs, model).collect():
        t = BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]
        stats, w = plain_statistics(t), words(t)
        bad = good = 0
        odds = math.log(model.labels.prior / (1 - model.labels.prior))
        for k, ((_, sign, worse, better, least), x) in enumerate(zip(quality_em.LABELLERS, stats, strict=True)):
            if len(w) >= least and sign * x >= sign * worse and not sign * x <= sign * better:
                bad += 1
                odds += math.log(model.labels.bad[1, k] / model.labels.bad[0, k])
            elif len(w) >= least and sign * x <= sign * better:
                good += 1
                odds += math.log((1 - model.labels.bad[1, k]) / (1 - model.labels.bad[0, k]))
        assert (r["n_words"], r["votes_bad"], r["votes_good"]) == (len(w), bad, good), t
        assert math.isclose(r["label_posterior"], 1 / (1 + math.exp(-odds)), rel_tol=1e-6, abs_tol=1e-12)
        count = collections.Counter()
        for x in w:
            raw = np.frombuffer(x.translate(LOWER).encode(), np.uint8)
            count[int(X.hashes(raw, np.array([0]), np.array([len(raw)]))[0]) >> (64 - quality_em.HASH_BITS)] += 1
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values())) or 1
        z = model.weights[-1] + sum(model.weights[k] * math.log1p(n) / norm for k, n in count.items())
        for k, ((_, _, worse, better, _), x) in enumerate(zip(quality_em.LABELLERS, stats, strict=True)):
            level = min(max(math.floor((x - (worse + better) / 2) / (abs(worse - better) / 4)) + quality_em.LEVELS // 2, 0), quality_em.LEVELS - 1)
            z += model.weights[(1 << quality_em.HASH_BITS) + quality_em.LEVELS * k + level]
        z += model.weights[(1 << quality_em.HASH_BITS) + quality_em.LEVELS * len(stats) + min(int(math.log2(len(w) + 1)), quality_em.LEVELS - 1)]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6, abs_tol=1e-9) and r["kept"] == (r["score"] >= 0.5)
        checked += 1
    assert checked == docs.count()


def test_prose_in_other_scripts_draws_no_bad_vote():
    russian = "Утром мы вышли из дома и долго шли вдоль реки. Вода была тихая, а небо светлое. Никто не говорил ни слова, и только птицы пели в старом саду?"
    greek = "Το πρωί βγήκαμε από το σπίτι και περπατήσαμε δίπλα στο ποτάμι. Το νερό ήταν ήσυχο και ο ουρανός καθαρός. Κανείς δεν μιλούσε για πολλή ώρα."
    chinese = "早上我们离开家，沿着河边走了很久。 水很平静，天空很明亮。 没有人说话， 只有鸟儿在老花园里唱歌。 后来我们回家了， 大家都很高兴。"
    hindi = "सुबह हम घर से निकले और नदी के किनारे बहुत देर तक चलते रहे। पानी शांत था और आकाश साफ़ था। कोई भी कुछ नहीं बोल रहा था।"
    stats, p, _ = quality_em.statistics(X.texts(pa.array([russian, greek, chinese, hindi])))
    assert (quality_em.votes(stats, p.counts) != quality_em.BAD).all()


def test_quality_sample_holds_each_text_once(spark, monkeypatch):
    r = random.Random(6)
    hot = prose(30, r)
    frame = spark.createDataFrame([(k, hot if k % 3 else prose(30, r)) for k in range(300)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality_em, "fit_scorer", lambda index, value, per, target: seen.append(len(per)) or np.zeros(quality_em.WIDTH + 1))
    quality_em.fit(frame, sample=1000)
    assert seen == [101]


# 2


def plain_measures(t):
    """n_tokens, the four measures: word by word with the libraries."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    w = words(t)
    ids = [i for x in w for i in pieces.encode(x)]
    count = collections.Counter(ids)
    chars, n_bytes = sum(map(len, w)), sum(len(whole.encode(x, add_special_tokens=False).ids) for x in w)
    return len(ids), chars / max(len(ids), 1), chars / max(n_bytes, 1), sum(pieces.is_byte(i) for i in ids) / max(len(ids), 1), -sum(n / len(ids) * math.log2(n / len(ids)) for n in count.values())


def plain_verdicts(rows):
    """kept of each row by the bands, from the measures."""
    names = ("chars_per_token", "chars_per_byte_token", "fallback_share")
    sound = [r for r in rows if not r["base_failed"]]
    size = lambda r: math.log2(max(r["n_tokens"], 1))
    x, y = [size(r) for r in sound], [r["entropy"] for r in sound]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    spread = sum((a - mx) ** 2 for a in x)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / spread if spread else 0.0
    rest = lambda r: r["entropy"] - (my - slope * mx) - slope * size(r)
    quartiles = lambda v: [sorted(v)[math.ceil(q * len(v)) - 1] for q in (0.25, 0.5, 0.75)]
    drawn = lambda v, above: [(len(v) * a + fertility.PRIOR * b) / (len(v) + fertility.PRIOR) for a, b in zip(quartiles(v), above, strict=True)] if v else above
    out = []
    for r in rows:
        ok = not r["base_failed"]
        alike = lambda s, *by: all(s[c] == r[c] for c in by)
        for n in names:
            low, mid, high = drawn([s[n] for s in sound if alike(s, "band")], quartiles([s[n] for s in sound]))
            slack = fertility.SLACK.get(n, 0.25)
            ok &= r[n] <= mid + max(slack, 4 * (high - mid)) and (n == "fallback_share" or r[n] >= mid - max(slack, 4 * (mid - low)))
        by_length = drawn([rest(s) for s in sound if alike(s, "length_class")], quartiles([rest(s) for s in sound]))
        low, mid, _ = drawn([rest(s) for s in sound if alike(s, "band", "length_class")], by_length)
        out.append(ok and rest(r) >= mid - max(fertility.SLACK["entropy"], 4 * (mid - low)))
    return out


FILES = {"pieces_file": public_tokenizers.path("piece_bpe_32k.model"), "bytes_file": public_tokenizers.path("byte_bpe_50k.json")}


def test_fertility(docs, empty):
    out = fertility.rate(docs.withColumn("band", F.lit("own")).withColumn("base_failed", F.lit("own")).withColumn("size", F.lit("own")), **FILES)
    assert len(out.columns) == len(set(out.columns)) and "kept" in out.columns
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["size"] == "own" and r["kept"] is not None for r in rows)
    for r in rows:
        t = BASE if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        w = words(t)
        many = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if many[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, twice = set(), 0
        for line in t.split("\n"):
            if words(line):
                twice += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(inside)), t[:40]
        assert r["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
        if len(t) < 5000:
            got = r["n_tokens"], r["chars_per_token"], r["chars_per_byte_token"], r["fallback_share"], r["entropy"]
            assert np.allclose(got, plain_measures(t), rtol=1e-9), t[:40]
        assert r["band"] == ("xx" if r["doc_id"] is not None else "latin")
    assert fertility.rate(empty, **FILES).count() == 0


def test_fertility_bands(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = fertility.rate(docs, **FILES).collect()
    assert [r["kept"] for r in rows] == plain_verdicts(rows)
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in rows) < len(rows) / 4


# 3


def test_attention_scores(spark, docs, empty):
    file = public_tokenizers.path("word_bpe_49k.json")
    flagged = docs.withColumn("train", F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)))
    rows = attention_lm.score(flagged, file=file).collect()
    tokens = {k: [*words(t, True), "\n"] for k, t in enumerate(TEXTS)} | {None: [*words(BASE, True), "\n"]}
    learnt = collections.Counter()
    for r in flagged.select("doc_id", "train").collect():
        if r["train"]:
            learnt.update(tokens[r["doc_id"]])
    n, v = sum(learnt.values()), len(learnt)
    assert len(rows) == docs.count()
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(learnt[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((learnt[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    assert attention_lm.score(empty.withColumn("train", F.lit(True)), file=file).count() == 0
    assert attention_lm.score(docs.withColumn("train", F.lit(False)), file=file).first()["train_tokens"] == 0


@pytest.mark.parametrize("head", [0, 40])
def test_base_scores_are_the_same_for_joined_words(docs, monkeypatch, head):
    file = public_tokenizers.path("word_bpe_49k.json")
    flagged = docs.withColumn("train", F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)))
    order = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_known"], r["base_score"]) for r in df.collect())
    whole = order(attention_lm.score(flagged, file=file))
    monkeypatch.setattr(attention_lm, "HEAD_WORDS", head)
    for got, want in zip(order(attention_lm.score(flagged, file=file)), whole, strict=True):
        assert got[:3] == want[:3] and math.isclose(got[3], want[3], rel_tol=1e-9), (got, want)


def plain_score(m, ids):
    """ln p of each id by the formula, one at a time, in loops."""
    out, group = [], [m.start, *[int(m.group[i]) for i in ids[:-1]]]
    for t, x in enumerate(ids):
        first = t // attention_lm.QUERIES * attention_lm.QUERIES - (attention_lm.KEYS - attention_lm.QUERIES)
        here = group[t]
        weights, values = [], []
        for u in range(first, t + 1):
            g = group[u] if u >= 0 else m.start
            weights.append(math.exp(sum(float(a) * float(b) for a, b in zip(m.query[here], m.key[g], strict=True)) + float(m.near[t - u])))
            values.append(m.value[g])
        mixed = [sum(w * float(v[k]) for w, v in zip(weights, values, strict=True)) / sum(weights) for k in range(len(values[0]))]
        logits = [float(m.direct[here][c]) + sum(mixed[k] * float(m.out[k][c]) for k in range(len(mixed))) for c in range(m.out.shape[1])]
        top = max(logits)
        row, at = int(m.row[here]), int(m.place[x])
        inside = m.pair[row][at] if at >= 0 else m.alone[int(row > 0)][x]
        out.append(logits[int(m.cls[x])] - top - math.log(sum(math.exp(y - top) for y in logits)) + float(inside))
    return out


def test_attention_scores_equal_a_plain_scorer(docs):
    file = public_tokenizers.path("word_bpe_49k.json")
    learnt = attention_lm.learn(docs.where("doc_id % 5 != 0"), file=file)
    whole = Tokenizer.from_file(file)
    e = Encoder(file, False)
    for r in attention_lm.score_with(docs, learnt, file=file).collect():
        t = BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]
        if len(t or "") < 2000:
            ids = [i for w in words(t) for i in whole.encode(w, add_special_tokens=False).ids] + [e.mark_id]
            if "<|" not in (t or ""):
                assert math.isclose(r["score"], sum(plain_score(learnt.model, ids)) / math.log(10), rel_tol=1e-4), t


def test_attention_beats_the_base_on_held_out_documents(spark, sf_dir):
    from cohortlake.llm.queries import op3_attention_lm

    rows = op3_attention_lm(spark, sf_dir.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_attention_learns_from_a_share_that_grows(spark, monkeypatch):
    file = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(4)
    rows = [(k, prose(30, r)) for k in range(600)]
    seen, summed = [], attention_lm._summed
    monkeypatch.setattr(attention_lm, "_summed", lambda *args: seen.append(summed(*args)) or seen[-1])
    monkeypatch.setattr(attention_lm, "LEAST_IDS", 100)
    for n in (200, 600):
        frame = spark.createDataFrame(rows[:n], "doc_id long, text string")
        attention_lm.learn(frame.unionByName(frame), file=file)
        monkeypatch.setattr(attention_lm, "TRAIN_SHARE", 0.25)
    few, many = seen[0][-1], seen[1][-1]
    assert 0 < few < many


def test_attention_learns_from_every_training_document(spark, monkeypatch):
    file = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(6)
    rows = [(k, prose(30, r)) for k in range(200)]
    rows += [(300, rows[0][1]), (301, None)]
    seen, summed = [], attention_lm._summed
    monkeypatch.setattr(attention_lm, "_summed", lambda *args: seen.append(summed(*args)) or seen[-1])
    monkeypatch.setattr(attention_lm, "LEAST_IDS", 100)
    attention_lm.learn(spark.createDataFrame(rows, "doc_id long, text string"), file=file)
    whole = Tokenizer.from_file(file)
    assert seen[0][-1] == sum(1 + sum(len(whole.encode(w, add_special_tokens=False).ids) for w in words(t)) for _, t in rows)


def test_attention_encodes_each_text_once(docs, monkeypatch):
    made, saved = {}, attention_lm.saved
    monkeypatch.setattr(attention_lm, "saved", lambda df, name: made.setdefault(name, []).append(df.inputFiles()) or saved(df, name))
    attention_lm.score(docs.withColumn("train", F.lit(True)), file=public_tokenizers.path("word_bpe_49k.json"))
    assert {n: len(x) for n, x in made.items()} == {"word-counts": 1, "encoded": 1, "scored": 1}
    assert made["scored"][0] and all("/encoded-" in f for f in made["scored"][0])


def test_word_encoder_equals_encoder():
    r = random.Random(8)
    marks = [*"abABsStTdDmMlLvVrReE019!-.,<|>&'", *"éÉÀÖØÞßøÿñ÷×\u00ad", "\u0130", "I\u0307", "J\u030c", "\u01f0", "H\u0331", "\u212a", "\u03a3", "日", "\u00a0", "\u3000", "\u200b", "\x01", "\x1c", "\x7f", "\u0301", "<|endoftext|>"]
    texts = [" ".join("".join(r.choices(marks, k=r.randint(1, 6))) for _ in range(r.randint(0, 9))) for _ in range(4000)] + [None, "", " \n"]
    column = pa.array(texts)
    file = public_tokenizers.path("word_bpe_49k.json")
    e, w = Encoder(file, False), WordEncoder(file, False)
    assert w.merging is not None
    t = X.texts(column)
    p = X.pieces(t, X.SPACES)
    want = e.encode_ended(column, e.mark_id, True)
    for _ in range(2):
        got = w.ended(*w.encode_pieces(t, p, X.hashes(t.data, p.starts, p.ends, X.LOWER)), e.mark_id)
        assert got[0].dtype == want[0].dtype and (got[0] == want[0]).all() and (got[1] == want[1]).all()


def random_counts(r, size=200):
    closing = np.arange(size) % 3 == 0
    pairs = r.integers(0, size, (2, 900))
    pairs = pairs[:, ~closing[pairs[0]]]
    n = r.integers(1, 20, pairs.shape[1])
    stated = np.stack([r.integers(1, 50, size), np.bincount(pairs[1], weights=n, minlength=size).astype(np.int64)])
    return attention_lm.Counts(stated, pairs[0], pairs[1], n, closing)


def test_attention_is_causal_a_distribution_and_counts_each_id_once():
    r = np.random.default_rng(0)
    documents = [r.integers(0, 200, r.integers(1, 90)) for _ in range(40)]
    model = attention_lm.fit(documents, random_counts(r))
    ids, per = np.concatenate(documents), np.array([len(d) for d in documents])
    whole = model.score(ids, per)
    alone = np.concatenate([model.score(d, np.array([len(d)])) for d in documents])
    assert np.allclose(whole, alone, atol=1e-4)
    changed = ids.copy()
    changed[per[0] - 1] = (changed[per[0] - 1] + 1) % 200
    assert np.allclose(model.score(changed, per)[: per[0] - 1], whole[: per[0] - 1], atol=1e-5)
    for lead in (documents[1][:4], [1, 2], [3]):
        spread = np.exp([model.score(np.append(lead, x).astype(int), np.array([len(lead) + 1]))[-1] for x in range(200)])
        assert abs(spread.sum() - 1) < 1e-3


# 4


def overlaps(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, names = split(text), set(), set()
    for name, body in items:
        i = split(body)
        k = min(window, len(i))
        for a in range(len(i) - k + 1 if i else 0):
            for b in range(len(w) - k + 1):
                if w[b : b + k] == i[a : a + k]:
                    hit |= set(range(b, b + k))
                    names.add(None if name is None else str(name))
    return len(w), len(hit), sorted(names, key=lambda x: (x is None, x or ""))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=24), max_size=5), st.text(alphabet="abcd ", max_size=60), st.integers(1, 4))
def test_automaton(items, text, window):
    named = list(enumerate(items))
    a = decontaminate.SuffixAutomaton([(str(k), b) for k, b in named], window)
    ids = [int(np.searchsorted(a.vocabulary, h)) if h in a.vocabulary else -1 for h in _hash(text)]
    spans, seen = [], set()
    a.scan(ids, 0, spans, seen)
    assert (len(ids), sum(y - x for x, y in spans), sorted(a.names(seen))) == overlaps(text, named, window)


def _hash(text):
    t = X.texts(pa.array([text]))
    p = X.pieces(t, X.NOT_ALNUM)
    return X.hashes(t.data, p.starts, p.ends, X.LOWER)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_decontamination(spark, docs, empty, block_words):
    items = [(1, " ".join(BASE.split()[5:30])), (10, "One, TWO"), (2, None), (3, "..."), (4, " ".join(BASE.split()[20:32])), (1, "日本語"), (None, "text that is nowhere at all"), (None, " ".join(BASE.split()[40:55])), ("null", " ".join(BASE.split()[60:75]))]
    bench = spark.createDataFrame([(None if k is None else str(k), t) for k, t in items], "item_id string, text string")
    found = decontaminate.find_overlaps(docs, bench, block_words=block_words)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = found.withColumn("hit", decontaminate.n_hit()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]
        if len(t or "") < 10_000:
            assert (r["n_words"], r["hit"], r["item_ids"]) == overlaps(t, items)
    clean = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert overlaps(clean[0], items)[1] == 0 and clean[3] == TEXTS[3] and clean[4] is None
    assert decontaminate.find_overlaps(empty, bench).count() == 0
    assert decontaminate.find_overlaps(docs, bench.limit(0)).where(decontaminate.n_hit() > 0).count() == 0


# 5


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_uses_each_piece_once_and_fills_best(counts):
    fillings = packing.plan(counts, 40)
    used = collections.Counter()
    for f in fillings:
        assert sum(x * n for x, n in zip(f.lengths, f.counts, strict=True)) <= 40
        for x, n in zip(f.lengths, f.counts, strict=True):
            used[x] += n * f.times
    assert used == collections.Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5))
def test_fill_is_closest(room, left):
    taken = packing.fill(room, left)
    sums = {0}
    for x, n in left.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room) and all(n <= left[x] for x, n in taken.items())


def test_packing(docs, empty):
    file = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(file)
    whole.encode_special_tokens = True
    rows = packing.pack(docs, file=file).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = [*whole.encode((BASE if r["doc_id"] is None else TEXTS[r["doc_id"]]) or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], len(ids)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    for k, parts in pieces.items():
        assert sum(n for _, n, _ in parts) == parts[0][2] * (2 if k == 3 else 1)
    assert packing.pack(empty, file=file).count() == 0


# 6


def test_token_files(spark, docs, empty, tmp_path):
    file = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(file)
    whole.encode_special_tokens = True
    made = token_files.write_token_files(docs, f"file://{tmp_path}/a", file=file)
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    want = [BASE, *[t for k, t in enumerate(TEXTS) for _ in range(2 if k == 3 else 1)]]
    at = 0
    for r, t in zip(rows, want, strict=True):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert rows[0]["doc_id"] is None and len(made) == len(want)
    assert made.document(1).tolist() == [*whole.encode(BASE, add_special_tokens=False).ids, 0]
    assert token_files.checksum(made.document(1)) == zlib.crc32(bytes(rows[1]["ids"]))
    token_files.write_token_files(empty, f"file://{tmp_path}/b", file=file)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


# 7


def test_url_lists(spark):
    day = 86400
    entries = [("bad", "Example.com", 10, True), ("bad", "example.com", 20, False), ("bad", "example.com", 20, False), ("bad", "a.example.com/x", 5, True), ("old", "example.com", 12, True), ("old", "example.com", 12, False), ("ip", "23.4", 1, True), (None, "b.com", 1, True), ("bad", "late.org", 30, True)]
    table = spark.createDataFrame(entries, "list string, pattern string, day long, listed boolean")
    cases = [
        (1, "https://u@a.Example.com.:80/x/y?q", 10 * day, 2, "a.example.com/x"),
        (2, "http://example.com", 10 * day - 1, 0, None),
        (3, "http://example.com/", 12 * day, 2, "example.com"),
        (4, "http://example.com/z", 20 * day, 1, "example.com"),
        (5, "http://1.23.4", 5 * day, 1, "23.4"),
        (6, "http://1.2.23.4/", 5 * day, 0, None),
        (7, None, 5 * day, 0, None),
        (8, "not a url", 5 * day, 0, None),
        (9, "http://late.org", None, 0, None),
        (None, "http://late.org", 31 * day, 1, "late.org"),
        (3, "http://example.com/", 12 * day, 2, "example.com"),
    ]
    captures = spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, fetched_at long")
    rows = url_lists.match(captures, table).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["url"], r["fetched_at"], r["n_active"], r["pattern"]) for r in rows), key=key) == sorted(cases, key=key)
    assert url_lists.match(captures, table.limit(0)).where("blocked").count() == 0
    assert url_lists.match(captures.limit(0), table).count() == 0


# 8


def test_langid(spark, docs, empty, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(real.where("doc_id % 3 != 1"))
    rows = langid.identify(real.where("doc_id % 3 = 1"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert odd[4] == odd[5] == odd[6] == "und" and odd[0] != "und" and odd[15] in model.languages
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred != 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_langid_equals_exact_sets_but_for_false_positives(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(real.where("doc_id % 3 != 1"))

    def pieces(text):
        folded = bytes(ord(" ") if c < 128 and not chr(c).isalpha() else c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        for w in folded.split(b" "):
            if w:
                padded = (b" " + w + b" ").ljust(langid.GRAM, b" ")
                yield from (padded[i : i + langid.GRAM] for i in range(max(1, len(w) + 3 - langid.GRAM)))

    rows, counts = real.collect(), collections.defaultdict(collections.Counter)
    for r in rows:
        if r["doc_id"] % 3 != 1 and r["lang"] and r["text"]:
            counts[r["lang"]].update(pieces(r["text"]))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    held = {x: {g for g, y in s.items() if y >= langid.MIN_SHARE and y * langid.MAX_RATIO >= top[g]} for x, s in share.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(real, model).collect()}
    for r in rows:
        own = list(pieces(r["text"]))
        if own:
            exact = {x: sum(g in s for g in own) / len(own) for x, s in held.items()}
            lang, score = got[r["doc_id"]]
            assert exact[lang] >= max(exact.values()) - 0.01 and abs(score - exact[lang]) < 0.02


def test_filter_masks_have_no_false_negatives():
    r = np.random.default_rng(0)
    codes, lang = np.unique(r.integers(0, 1 << 32, 5000)).astype(np.uint64), r.integers(0, 70, 5000)
    f = langid.LanguageFilter([f"l{k:02}" for k in range(70)], lang[: len(codes)], codes, slots=1 << 14)
    masks = f.masks(codes)
    assert all(int(masks[k // 64, i]) >> (int(k) % 64) & 1 for i, k in enumerate(lang[: len(codes)].tolist()))
    others = np.setdiff1d(r.integers(1 << 33, 1 << 34, 20_000).astype(np.uint64), codes)
    share = np.mean([[int(m) >> k & 1 for k in range(6)] for m in f.masks(others)[0].tolist()], axis=0)
    assert np.abs(share - f.false_rate[:6]).max() < 0.01


# 9


def dedup_by_hand(texts, gram, window):
    """The definition, line by line, over (id, text) in order."""
    lines = {k: [x.strip(" \t\n\r\x0b\x0c") for x in (t or "").split("\n") if words(x)] for k, t in texts.items()}

    def run(body, i, least):
        n = 0
        for j in range(i, len(body)):
            n += len(words(body[j]))
            if n >= least:
                return j + 1
        return None

    t_hash = lambda s: X.hashes(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s.encode())]))
    first, later = {}, []
    for k in sorted(lines):
        body = lines[k]
        h = np.concatenate([t_hash(x) for x in body]) if body else np.zeros(0, np.uint64)
        ends = [e for i in range(len(body)) if (e := run(body, i, gram))]
        if not ends:
            continue
        values = line_dedup._joined(h, np.array(ends)).tolist()
        stops = [e for i in range(len(body)) if (e := run(body, i, window))] or [len(body)]
        picked = set()
        for i, stop in enumerate(stops):
            inside = [j for j in range(i, len(ends)) if ends[j] <= stop]
            picked.add(max(inside, key=lambda j: (-values[j], j)))
        for j in sorted(picked):
            if values[j] in first:
                later.append((k, j, first[values[j]]))
            else:
                first[values[j]] = (k, j)
    gone = {k: set() for k in lines}
    for k, j, (a, b) in later:
        for step in (1, -1):
            x, y = j, b
            while 0 <= x < len(lines[k]) and 0 <= y < len(lines[a]) and lines[k][x] == lines[a][y]:
                gone[k].add(x)
                x, y = x + step, y + step
    return {k: len(v) for k, v in gone.items()}


def test_line_dedup(spark, docs, empty):
    r = random.Random(3)
    passages = [[prose(r.randint(3, 30), r) for _ in range(r.randint(1, 6))] for _ in range(8)]
    texts = {k: "\n".join(x for _ in range(r.randint(0, 6)) for x in (r.choice(passages) if r.random() < 0.6 else ["", prose(r.randint(1, 20), r)])) for k in range(80)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = {x["doc_id"]: x for x in line_dedup.dedup_lines(frame).collect()}
    assert {k: x["n_gone_lines"] for k, x in rows.items()} == dedup_by_hand(texts, line_dedup.GRAM_WORDS, line_dedup.WINDOW_WORDS)
    for k, x in rows.items():
        assert len(x["text"].split("\n")) == max(1, x["n_lines"] - x["n_gone_lines"]) and len(words(x["text"])) == x["n_line_words"] - x["n_gone_words"], k
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs).collect()}
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert out[None]["text"] == BASE and not words(out[0]["text"]) and out[4]["text"] is None and out[3]["text"] == TEXTS[3]
    assert out[11]["n_gone_lines"] == 2
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_takes_single_short_lines_exactly_when_asked(spark):
    r = random.Random(9)
    rows = [(k, f"{prose(30, r)} {k}\nthe same six words as others\n{prose(30, r)} {k}") for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert line_dedup.dedup_lines(frame).where("n_gone_lines > 0").count() == 0
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(frame, gram_words=1, window_words=1).collect()}
    assert out[0] == rows[0][1] and all(out[k] == "\n".join(t.split("\n")[::2]) for k, t in rows[1:])


@pytest.mark.parametrize("least", [2, 100])
def test_line_dedup_is_the_same_when_hot_grams_and_sources_are_salted(spark, monkeypatch, least):
    monkeypatch.setattr(shared, "LEAST_SPLIT", least)
    r = random.Random(12)
    passage, other = "\n".join(prose(30, r) for _ in range(3)), "\n".join(prose(30, r) for _ in range(2))
    texts = {k: f"{prose(40, r)}\n{passage}\n{prose(10, r)}" + (f"\n{other}" if k % 3 == 0 else "") for k in range(60)} | {100: None, 101: ""}
    frame = spark.createDataFrame([*texts.items(), (None, texts[0]), (5, texts[5])], "doc_id long, text string").repartition(5)
    rows = line_dedup.dedup_lines(frame.withColumn("gone", F.lit("own")).withColumn("text_hash", F.lit(1))).collect()
    assert len(rows) == len(texts) + 2 and all(x["gone"] == "own" and x["text_hash"] == 1 for x in rows)
    got = {x["doc_id"]: x["n_gone_lines"] for x in rows}
    # the row without an id comes first, so document 0 is a copy of it
    want = dedup_by_hand({-1: texts[0], **texts}, line_dedup.GRAM_WORDS, line_dedup.WINDOW_WORDS)
    assert got == {None if k == -1 else k: n for k, n in want.items()}


# 10


def groups_by_hand(texts):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t, True)) else set() for k, t in texts.items()}
    up = {k: k for k in texts}

    def find(k):
        return k if up[k] == k else find(up[k])

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize("limit", [500_000, 300])
def test_trie_join(spark, limit):
    r = random.Random(5)
    texts = {}
    for k in range(90):
        w = (texts[r.choice(list(texts))] or "x").split() if texts and r.random() < 0.75 else prose(r.randint(1, 90), r).split()
        for _ in range(r.choice((0, 1, 1, 2, 4))):
            if w:
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
        texts[k] = " ".join(w[: len(w) - r.choice((0, 0, 3))]) or None
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in trie_join.similar_groups(frame, trie_shingles=limit).collect()}
    assert got == groups_by_hand(texts)


@pytest.mark.parametrize("limit", [500_000, 300])
def test_trie_join_yields_all_links(spark, limit):
    r = random.Random(8)
    base = [prose(60, r) for _ in range(3)]
    texts = []
    for k in range(40):
        w = r.choice(base).split()
        w[r.randrange(60)] = r.choice(VOCABULARY)
        texts.append((k, " ".join(w)))
    texts += [(50, texts[0][1]), (51, texts[0][1]), (3, texts[4][1]), (3, texts[3][1]), (None, texts[0][1]), (60, None), (61, "one two"), (62, "ONE two")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t, True)) else set() for _, t in texts]
    least = lambda s: min(k for (k, _), x in zip(texts, sets, strict=True) if k is not None and x == s)
    alike = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    want = []
    for i, (k, _) in enumerate(texts):
        links = sum(j != i and x[0] is not None and alike(sets[i], sets[j]) for j, x in enumerate(texts))
        want.append((k, len(sets[i]), None, 0) if k is None else (k, len(sets[i]), least(sets[i]) if sets[i] else k, links))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = [(x["doc_id"], x["n_shingles"], x["class_id"], x["n_links"]) for x in trie_join.similar_groups(frame, trie_shingles=limit).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    named = [(least(s), s) for (k, _), s in zip(texts, sets, strict=True) if k is not None and s]
    pairs = [(x["u"], x["v"]) for x in trie_join.similar_pairs(frame, trie_shingles=limit).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, s in named for b, t in named if a < b and alike(s, t)}


def test_trie_join_ranks_all_common_shingles(spark, monkeypatch):
    """Passages of three documents each chain all of them; no number of passages may make these one group."""
    monkeypatch.setattr(trie_join, "COMMON", 20, raising=False)
    groups, keep = [], trie_join.saved
    monkeypatch.setattr(trie_join, "saved", lambda df, name: groups.append(keep(df, name)) or groups[-1] if name == "trie-members" else keep(df, name))
    r = random.Random(4)
    made = lambda n: " ".join(str(r.random()) for _ in range(n))
    shared_parts = [made(20) for _ in range(62)]
    texts = {k: " ".join(f"{x} {made(14)}" for x in shared_parts[k : k + 3]) for k in range(60)}
    texts[60] = texts[7] + " more"
    texts[61] = texts[60] + " words"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in trie_join.similar_groups(frame).collect()}
    assert got == groups_by_hand(texts)
    assert groups[0].count() < 20


def test_trie_join_does_not_group_pairs_that_cannot_link(spark, monkeypatch):
    """Passages of two documents each are no common shingles, and chain all documents."""
    groups, keep = [], trie_join.saved
    monkeypatch.setattr(trie_join, "saved", lambda df, name: groups.append(keep(df, name)) or groups[-1] if name == "trie-members" else keep(df, name))
    r = random.Random(5)
    made = lambda n: " ".join(str(r.random()) for _ in range(n))
    passages = [made(40) for _ in range(61)]
    texts = {k: f"{passages[k]} {made(30)} {passages[k + 1]}" for k in range(60)}
    texts[60] = texts[7] + " more"
    texts[61] = texts[60] + " words"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in trie_join.similar_groups(frame).collect()}
    assert got == groups_by_hand(texts)
    assert groups[0].count() == 3


def test_sketches_allow_every_link():
    r = np.random.default_rng(6)
    for n in (1, 2, 5, 63, 64, 65, 130, 1000, 3000):
        base = trie_join.X.mix(np.arange(1, 2 * n + 20, dtype=np.uint64) + np.uint64(n << 20))
        for gone, added in r.integers(0, n // 5 + 2, (40, 2)):
            a, b = base[:n], base[min(gone, n - 1) : n + added]
            both = len(np.intersect1d(a, b))
            sizes = np.array([len(a), len(b)])
            one, two = trie_join._sketches(np.concatenate([a, b]), sizes).to_pylist()
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert trie_join.may_link(len(a), one, len(b), two)
                assert trie_join.may_link(len(b), two, len(a), one)
        if n > 4:
            one, two = trie_join._sketches(base[: 2 * n], np.array([n, n])).to_pylist()
            assert not trie_join.may_link(n, one, n, two)


def test_trie_join_odd_rows(docs, empty):
    rows = trie_join.similar_groups(docs).collect()
    got = {x["doc_id"]: x["component_id"] for x in rows}
    assert len(rows) == docs.count() and got[1] == 0 and got[8] == 7 and got[5] == 5 and got[None] is None
    assert trie_join.similar_groups(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1), min_size=1, max_size=14))
def test_trie_finds_each_link(sets):
    trie = trie_join.Trie([tuple(sorted(s)) for s in sets])
    for q, mine in enumerate(sets):
        assert sorted(trie.all_links(q)) == [k for k, s in enumerate(sets) if k != q and 100 * len(mine & s) >= 80 * len(mine | s)]


@pytest.mark.parametrize("least", [3, 100])
def test_components(spark, monkeypatch, least):
    monkeypatch.setattr(shared, "LEAST_SPLIT", least)
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (200, 200), (None, 3)] + [(300 + k, 300) for k in range(1, 50)]
    up = {x: x for e in edges for x in e if None not in e}

    def find(k):
        return k if up[k] == k else find(up[k])

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in up}
