"""Toxicity, language ID and LM scoring by held-out results and brute force; packing by round trip; the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from trellis.llm import langid, lattice_lm, packing, quality, registry, toxicity
from tests.llm.test_chosen_path import brute as brute_join
from tests.llm.test_substring_decontam import brute_decontam, brute_substring, words_of

DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()), T.StructField("doc", T.StringType())])
ODD = [None, "", " \n", "12 34 !?", "É", "a" * 200_000, "x y " * 30_000]


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang, "s", "d") for i, t in enumerate(texts)], DOCS)


# ---- toxicity ---------------------------------------------------------------------------


def made_up(seed, n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilezork", "grubnaff"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_finds_held_out_texts(spark):
    rows = made_up(3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    train = toxicity.labelled(docs.where("doc_id % 3 <> 0"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, *toxicity.train_model(train)).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.97 * len(held)


def test_toxicity_defined_cases(spark):
    none = spark.createDataFrame([], "text string, y int")
    model = toxicity.train_model(none)
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame(spark, ODD), *model).collect())
    one = toxicity.train_model(spark.createDataFrame([("a b", 1), ("c d", 1)], "text string, y int"))
    assert toxicity.score(frame(spark, ["x"]), *one).first().score > 0.9
    assert toxicity.score(frame(spark, []), *model).count() == 0


def test_pieces_cover_a_text():
    for n in (1, 100, 1559, 1560, 1561, 5000, 100_001):
        ranges = toxicity.pieces_of(n)
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(b[0] < a[1] for a, b in itertools.pairwise(ranges))


# ---- language ---------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    rows = registry.op3_language_id(spark, DIR).join(registry.documents(spark, DIR).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_defined_cases(spark):
    train = spark.createDataFrame([("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"), ("odd", None), (None, "en")], "text string, lang string")
    got = {r.doc_id: r for r in langid.predict(frame(spark, [*ODD, "the dog", "die katze"]), langid.fit(train)).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and all(got[i].score == 0 for i in range(4))
    assert got[len(ODD)].lang_pred == "en" and got[len(ODD) + 1].lang_pred == "de"
    assert langid.fit(train.limit(0)) is None and langid.predict(frame(spark, ["a"]), None).first().lang_pred == "und"
    assert langid.predict(frame(spark, []), langid.fit(train)).count() == 0


def test_kernel_counts_common_grams():
    def grams(t):
        t = " " + " ".join(re.findall("[a-z]+", t)) + " "
        return {t[i : i + n] for n in range(1, langid.GRAMS + 1) for i in range(len(t) - n + 1)}

    a, b = "the cat, sat", "that cat sits"
    assert len(langid.grams_of(a)) == len(grams(a)) and len(np.intersect1d(langid.grams_of(a), langid.grams_of(b))) == len(grams(a) & grams(b))
    # features reproduce the kernel between landmarks
    texts = [a, b, "dogs bark", "the dog and the cat"]
    x, has = langid.Kernel(texts).features([*texts, "12", None])
    kernel = x @ x.T
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert abs(float(kernel[i, j]) - len(grams(s) & grams(t)) / math.sqrt(len(grams(s)) * len(grams(t)))) < 1e-3
    assert has.tolist() == [True] * 4 + [False] * 2 and not x[4:].any()


# ---- LM ---------------------------------------------------------------------------------


def test_lattice_sums_over_all_segmentations():
    pieces = lattice_lm.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"], np.log([0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1]))
    prob = dict(zip(pieces.pieces, np.exp(pieces.logp), strict=True))
    byte = math.log(0.1 / 256)

    def brute(text):
        if not text:
            return 1.0
        total = sum(prob[text[:k]] * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in prob)
        return total + (math.exp(byte * len(text[0].encode())) * brute(text[1:]) if text[0] not in prob else 0)

    words = ["a", "ab", "abab", "bab", "é", "aéb", "ba", "漢b"]
    got = lattice_lm.word_scores(words, pieces, byte)
    assert np.allclose(got, [math.log(brute("▁" + w)) for w in words])


def test_em_raises_the_likelihood():
    pieces = ["▁", "a", "b", "ab", "▁ab", "▁a"]
    words, counts = ["ab", "abab", "b", "a"], np.array([5.0, 3, 1, 2])
    p, before = np.array([1, 1, 1, 1, 1, 1, 0.1]) / 6.1, -np.inf
    for _ in range(5):
        model, byte = lattice_lm.Pieces(pieces, np.log(p[:-1])), math.log(p[-1] / 256)
        now = (lattice_lm.word_scores(words, model, byte) * counts).sum()
        assert now >= before - 1e-9
        before = now
        p = lattice_lm.expected_counts(words, counts, model, byte) + 1e-12
        p /= p.sum()


@pytest.mark.parametrize("head", [3, 1 << 17])
def test_base_scores(spark, head):
    texts = [*ODD[:5], "The the THE cat", "a\x0bb\x0cc é É", "x y " * 3000, "unseen words"]
    docs = frame(spark, texts)
    train = docs.where("doc_id <> 8")
    tok = lambda s: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    counts, ends = Counter(w for t in texts[:8] for w in tok(t)), 8
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {r.doc_id: r for r in lattice_lm.score(docs, train, registry.piece_model(), head=head).collect()}
    for i, text in enumerate(texts):
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in tok(text)), ends])
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].n_known == 1 + sum(counts[w] > 0 for w in tok(text))
        assert (got[i].n_tokens, got[i].train_tokens) == (len(tok(text)) + 1, n) and -1e7 < got[i].score < 0
    empty = lattice_lm.score(docs, docs.limit(0), registry.piece_model()).where("doc_id = 5").first()
    assert empty.n_known == 0 and empty.train_tokens == 0 and empty.score < 0


# ---- packing ----------------------------------------------------------------------------


def naive_best_fit(sizes, length):
    rows, left = [], []
    for i in np.argsort(-sizes, kind="stable").tolist():
        fits = [c for c in left if c >= sizes[i]]
        if fits:
            k = max(j for j, c in enumerate(left) if c == min(fits))
            rows[k].append(i)
            left[k] -= sizes[i]
        else:
            rows.append([i])
            left.append(length - sizes[i])
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(sizes):
    sizes = np.array(sizes, np.int64)
    rows = packing.best_fit_decreasing(sizes, 16)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes))) and all(sizes[r].sum() <= 16 for r in rows)
    assert sorted(sizes[r].sum() for r in rows) == sorted(sizes[r].sum() for r in naive_best_fit(sizes, 16))


@pytest.mark.parametrize("length,block", [(64, 1 << 21), (64, 500), (2048, 1 << 21)])
def test_packing_is_lossless(spark, length, block):
    ranks, pattern, end = registry.byte_ranks()
    docs = frame(spark, [*ODD, *(r.text for r in registry.documents(spark, DIR).limit(50).collect())])
    encode = packing.encoder_for(ranks, pattern).encode_ordinary
    parts = {}
    for r in packing.pack(docs, ranks, pattern, end, length=length, block_tokens=block).collect():
        ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(positions) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert (positions[a:b] == np.arange(b - a)).all()
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for d in docs.collect():
        assert [x for _, p in sorted(parts[d.doc_id]) for x in p] == [*encode(d.text or ""), end]
    assert packing.pack(frame(spark, []), ranks, pattern, end).count() == 0


# ---- the pipeline -----------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    docs = registry.documents(spark, DIR).collect()
    kept = {r.doc_id for r in quality.measure(registry.documents(spark, DIR)).where("kept").collect()}
    rows = sorted((d.doc_id, d.text) for d in docs if d.doc_id in kept)
    classes = brute_join(rows, 0.8)
    rows = [r for r in rows if classes[r[0]][0] == r[0]]
    cut = {}
    for doc, text in rows:
        cut[doc] = text
    seen = set()
    for doc, text in rows:  # as brute_substring, with the kept words
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        if gone:
            cut[doc] = " ".join(w for i, w in enumerate(words) if i not in gone)
    rows = [(d, t) for d, t in cut.items() if t]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = [r for r, found in zip(sorted(rows), sorted(brute_decontam(rows, items), key=lambda x: x[0]), strict=True) if not found[2]]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=registry.piece_model())
    want = {d: [1, *library.encode(t), 2] for d, t in rows}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and len(got) > 100


def test_pipeline_stages_keep_the_columns(spark):
    columns = registry.documents(spark, DIR).columns
    docs = registry.documents(spark, DIR).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == 0


def test_every_operator_has_a_query():
    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and set(registry.oracle_sql()) <= set(names)
    assert words_of("A-b É1") == ["a", "b", "É1"] and brute_substring([], 5) == {} and zlib.crc32(b"1") % 5 >= 0
