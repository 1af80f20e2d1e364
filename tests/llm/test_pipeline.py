"""The pipeline's stages, each against a plain version of itself over the stage's own input, and run() against the last."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cohortlake.llm import line_dedup, quality_em, trie_join
from cohortlake.llm import text as X
from cohortlake.llm.shared import table

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(WORD, (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = table(spark, sf_dir, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_clean_documents(spark, stages, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "trie_join", "decontaminate", "packing"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns
        assert all(r["n_chars"] == len(r["text"]) for r in stages[n].collect() if r["text"] is not None)
    # test_quality_equals_a_plain_version holds the verdicts; here rejected documents go and others are whole
    judged = {r["doc_id"]: r["kept"] for r in quality_em.classify(stages["documents"], quality_em.fit(stages["documents"])).collect()}
    assert texts(stages["quality"]) == {k: t for k, t in texts(stages["documents"]).items() if judged[k]}
    good = {r["doc_id"] for r in table(spark, sf_dir, "labels").collect() if r["quality"] == 1}
    assert len(good & set(texts(stages["quality"]))) > 0.95 * len(good)


def line_hash(line):
    raw = np.frombuffer(line.encode(), np.uint8)
    return X.hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def without_repeated_lines(bodies):
    """The line stage in loops over (id, text) in order."""
    solid = {k: [i for i, x in enumerate(t.split("\n")) if re.search(WORD, x)] for k, t in bodies.items()}
    trimmed = {k: [t.split("\n")[i].strip(" \t\n\r\x0b\x0c") for i in solid[k]] for k, t in bodies.items()}
    first, gone = {}, {k: set() for k in bodies}
    matches = []
    for k in sorted(bodies):
        n = [len(re.findall(WORD, x)) for x in trimmed[k]]

        def until(i, least, n=n):
            total = 0
            for j in range(i, len(n)):
                total += n[j]
                if total >= least:
                    return j + 1
            return None

        ends = [e for i in range(len(n)) if (e := until(i, line_dedup.GRAM_WORDS))]
        if not ends:
            continue
        values = line_dedup._joined(np.array([line_hash(x) for x in trimmed[k]]), np.array(ends)).tolist()
        stops = [e for i in range(len(n)) if (e := until(i, line_dedup.WINDOW_WORDS))] or [len(n)]
        for j in sorted({max((j for j in range(i, len(ends)) if ends[j] <= stop), key=lambda j: (-values[j], j)) for i, stop in enumerate(stops)}):
            if values[j] in first:
                matches.append((k, j, first[values[j]]))
            else:
                first[values[j]] = (k, j)
    for k, j, (a, b) in matches:
        for step in (1, -1):
            x, y = j, b
            while 0 <= x < len(trimmed[k]) and 0 <= y < len(trimmed[a]) and trimmed[k][x] == trimmed[a][y]:
                gone[k].add(x)
                x, y = x + step, y + step
    out = {}
    for k, t in bodies.items():
        lost = {solid[k][i] for i in gone[k]}
        if not lost or any(i not in lost for i in solid[k]):
            out[k] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
    return out


def test_repeated_lines_go(stages):
    before = texts(stages["quality"])
    want = without_repeated_lines(before)
    assert texts(stages["line_dedup"]) == want and want != before


def test_one_of_each_group_stays(stages):
    before = {k: shingles(t) for k, t in texts(stages["line_dedup"]).items()}
    up = {k: k for k in before}

    def find(k):
        return k if up[k] == k else find(up[k])

    for a in before:
        for b in before:
            if a < b and before[a] and 100 * len(before[a] & before[b]) >= 80 * len(before[a] | before[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert texts(stages["trie_join"]) == {k: t for k, t in texts(stages["line_dedup"]).items() if find(k) == k}


def test_rows_of_one_id_and_without_one_are_judged_by_their_texts(spark):
    words = [f"w{k}" for k in range(400)]
    body = lambda k: " ".join(words[k : k + 40])
    near = body(0).replace("w39", "other")
    rows = [(1, body(0)), (2, body(50)), (2, body(100)), (2, body(100)), (None, near), (None, body(150)), (None, body(150)), (3, body(150)), (4, ""), (4, ""), (None, None)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    kept = corpus_pipeline.similar(spark, spark.createDataFrame(rows, schema).repartition(3), "").collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter([(1, body(0)), (2, body(50)), (2, body(100)), (3, body(150)), (4, ""), (None, None)])


def test_similar_does_not_group_texts_that_passages_chain(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "COMMON", 20, raising=False)
    sizes, keep = [], trie_join.saved

    def saved(df, name):
        out = keep(df, name)
        if name == "trie-members":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(trie_join, "saved", saved)
    made = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    rows = [(k, " ".join(f"{made(f'p{k + j}', 20)} {made(f'own{k}a{j}', 14)}" for j in range(3))) for k in range(60)]
    frame = spark.createDataFrame([*rows, (60, rows[7][1] + " more")], "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.similar(spark, frame, "").collect()
    assert sorted(map(tuple, kept)) == rows
    assert sizes[0] < 20


def test_benchmark_passages_are_cut(spark, stages, sf_dir):
    ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [re.findall(ALNUM, (r["text"] or "").translate(LOWER)) for r in table(spark, sf_dir, "benchmark").collect()]
    windows = collections.defaultdict(set)
    for w in items:
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[k].add(tuple(w[i : i + k]))
    want, cut = {}, 0
    for key, t in texts(stages["trie_join"]).items():
        at = list(re.finditer(ALNUM, t.translate(LOWER)))
        w = [m[0] for m in at]
        hit = {j for k, known in windows.items() for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in known for j in range(i, i + k)}
        cut += bool(hit)
        if len(hit) > 0.5 * len(w):
            continue
        out, end, j = [], 0, 0
        while j < len(w):
            if j in hit:
                last = j
                while last + 1 in hit:
                    last += 1
                out.append(t[end : at[j].start()])
                end, j = at[last].end(), last
            j += 1
        want[key] = "".join([*out, t[end:]])
    assert texts(stages["decontaminate"]) == want and cut


def test_packing_and_run_hold_every_text(spark, sf_dir, stages):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    want = {}
    for k, t in texts(stages["decontaminate"]).items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want |= {(k, a): (ids[a : a + 2048], len(ids)) for a in range(0, len(ids), 2048)}
    for rows in (stages["packing"].collect(), entry.queries()["pipeline"](spark, sf_dir).collect()):
        assert {(r["doc_id"], r["start"]): (np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]) for r in rows} == want and len(rows) == len(want)
        sequences = collections.defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048
        assert sorted(sequences) == list(range(len(sequences)))
