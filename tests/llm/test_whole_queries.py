"""The learned queries against brute-force versions of the whole, repeated rows, unsegmented text, scratch tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm import decontam, langid, lattice_lm, quality, registry, sharding, shared, spm, toxicity


def written(spark, path, rows, labels=None):
    """A folder of documents (doc_id, text, lang) and labels."""
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def held(doc, n):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % n


# ---- toxicity ---------------------------------------------------------------------------------


def test_toxicity_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    rows, labels = [], []
    for i in range(80):
        words = [word() for _ in range(rng.randint(3, 40))] + (["zzvile"] if i % 3 == 0 else [])
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", "\n"]).join(words).upper() if i % 2 else " ".join(words), None))
        labels.append((i, int(i % 3 == 0)))
    rows += [(5, rows[7][1], None), (200, None, None), (201, "", None), (None, "zzvile", None)]
    folder = written(spark, tmp_path, rows, labels + [(5, 1)])
    got = sorted(((r.doc_id, r.score) for r in registry.op1_toxicity(spark, folder).collect()), key=str)

    def features(text):
        text = " " + " ".join((text or "").lower().split()) + " "
        grams = {text[i : i + n] for n in toxicity.GRAMS for i in range(len(text) - n + 1)}
        size = lambda g: toxicity.gram_buckets(np.array([ord(c) for c in g], np.uint32))[toxicity.GRAMS.index(len(g)), 0]
        return {int(size(g)) for g in grams}

    of = defaultdict(int)
    for i, y in labels + [(5, 1)]:
        of[i] = max(of[i], y)
    train = [(features(t), of[i]) for i, t, _ in rows if i in of and held(i, 5)]
    counts = np.ones((2, toxicity.FEATURES))
    for f, y in train:
        for b in f:
            counts[y, b] += 1
    r = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    used = sorted(set().union(*(f for f, _ in train)))
    x = np.array([[float(b in f) for b in used] for f, _ in train]) * r[used] / math.sqrt(np.mean([len(f) for f, _ in train]))
    y = np.array([v for _, v in train])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    curve = 0.25 * (weight * ((x**2).sum(1) + 1)).sum() + toxicity.PENALTY
    w = ahead_w = np.zeros(len(used))
    b = ahead_b = 0.0
    t = 1.0
    for _ in range(toxicity.STEPS):
        g = weight * (1 / (1 + np.exp(-(x @ ahead_w + ahead_b))) - y)
        new_w, new_b = ahead_w - (x.T @ g + toxicity.PENALTY * ahead_w) / curve, ahead_b - g.sum() / curve
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead_w, ahead_b = new_w + (before - 1) / t * (new_w - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new_w, new_b
    final = dict(zip(used, w * r[used] / math.sqrt(np.mean([len(f) for f, _ in train])), strict=True))
    want = sorted(((i, 1 / (1 + math.exp(-(sum(final.get(k, 0.0) for k in features(t)) + b)))) for i, t, _ in rows), key=str)
    assert [g[0] for g in got] == [v[0] for v in want] and np.allclose([g[1] for g in got], [v[1] for v in want], atol=1e-4)


def test_toxicity_of_many_copies(spark):
    rows = spark.range(60_000).selectExpr("id % 2 AS y", "CASE id % 2 WHEN 1 THEN 'you vile grubnaff' ELSE 'the cat sat on the mat' END AS text")
    model = toxicity.train_model(rows.selectExpr("text", "cast(y as int) AS y"), sample=200)
    docs = spark.createDataFrame([(1, "you vile grubnaff"), (0, "the cat sat on the mat"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, *model).collect()}
    assert got[1] > 0.9 and got[0] < 0.1 and 0 <= got[2] <= 1


def test_fitting_holds_its_rows_once():
    """The rows give way to the chunks made of them, so the sample is not in the driver's memory twice."""
    import tracemalloc

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 1 << 12, 3000)).astype(np.int32) for _ in range(1000)]
    size, y, r = sum(x.nbytes for x in rows), np.arange(1000) % 2, rng.normal(size=1 << 12)
    tracemalloc.start()
    weights, b = toxicity.fit(rows, y, r)
    assert not rows and np.isfinite(weights).all() and np.isfinite(b)
    assert tracemalloc.get_traced_memory()[1] < 2.2 * size
    tracemalloc.stop()


def test_hash_limit_takes_enough():
    assert shared.hash_limit(2000, 1500) == 1 << 30 and 2000 <= shared.hash_limit(2000, 100_000) / (1 << 30) * 100_000 <= 2800


# ---- language ---------------------------------------------------------------------------------


def test_language_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    lexicon = {"en": "the cat and dog sat with that thing over there".split(), "de": "der hund und die katze saß über dem größten ding".split(), "fr": "le chat et la souris été où ça était très".split()}
    rows = [(i, " ".join(rng.choice(lexicon[x]) for _ in range(rng.randint(4, 30))), x) for i in range(90) for x in [("en", "de", "fr")[i % 3]]]
    rows += [(100, None, "en"), (101, "12 !", "xx"), (102, "the dog", None), (103, rows[3][1], "en"), (3, rows[4][1], "de")]
    folder = written(spark, tmp_path, rows)
    docs = registry.documents(spark, folder)
    marks, langs = langid.landmarks(docs.where(registry.bucket_of(F.col("doc_id"), 4) != 2))
    assert langs == ["de", "en", "fr"]  # a language without letters is not learned

    def grams(text):
        text = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
        return {text[i : i + n] for n in range(1, langid.GRAMS + 1) for i in range(len(text) - n + 1)} if text.strip() else set()

    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0
    own = [grams(m) for m in marks]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in own] for a in own]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    feature = lambda text: np.append(np.array([kernel(grams(text), b) for b in own]) @ root, 1.0)
    train = [(feature(t), x) for i, t, x in rows if held(i, 4) != 2 and x is not None and grams(t)]
    x = np.array([f for f, _ in train])
    y = np.array([[1.0 if v == z else -1.0 for z in langs] for _, v in train])
    w = np.linalg.solve(x.T @ x + langid.RIDGE * len(x) * np.eye(x.shape[1]) / x.shape[1], x.T @ y)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in registry.op3_language_id(spark, folder).collect()), key=str)
    want = []
    for i, t, _ in rows:
        out = feature(t) @ w
        best = out.argmax()
        want.append((i, langs[best], 1 / np.exp(3 * (out - out[best])).sum()) if grams(t) else (i, "und", 0.0))
    want.sort(key=str)
    by_id = lambda rows: sorted((str(i), x, round(float(s), 2)) for i, x, s in rows)
    assert [r[:2] for r in by_id(got)] == [r[:2] for r in by_id(want)] and np.allclose([r[2] for r in by_id(got)], [r[2] for r in by_id(want)], atol=0.03)


def test_language_of_many_copies_and_without_letters(spark):
    copies = spark.range(6_000).selectExpr("CASE id % 2 WHEN 1 THEN 'der hund und die katze' ELSE 'the dog and the cat' END AS text", "CASE id % 2 WHEN 1 THEN 'de' ELSE 'en' END AS lang")
    train = copies.unionByName(spark.createDataFrame([("12 34", "xx"), ("!", "xx")], "text string, lang string"))
    model = langid.fit(train)
    docs = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, "12")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {1: "en", 2: "de", 3: "und"}
    assert langid.fit(train.where("lang = 'xx'")) is None


def test_very_many_languages_share_the_landmarks(spark, monkeypatch):
    rows = [(f"text number {i} of {'abcdefghij'[i % 10] * 5}", f"l{i % 600:03d}") for i in range(1300)]
    train = spark.createDataFrame(rows, "text string, lang string")
    marks, langs = langid.landmarks(train)
    assert len(marks) == langid.LANDMARKS and len(langs) == 600 and langs == sorted(langs)
    monkeypatch.setattr(langid, "LANGS", 5)
    marks, langs = langid.landmarks(train.unionByName(train.where("lang < 'l004'")))
    assert langs == ["l000", "l001", "l002", "l003", "l004"]
    model = langid.fit(train.where("lang < 'l300'"))
    got = langid.predict(spark.createDataFrame([(1, "text"), (2, "12")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred in [*langs, "und"] for r in got} == {1: True, 2: True}


def test_frequent_words_are_bounded_by_bytes(spark):
    words = spark.createDataFrame([("x" * 1000 + str(i), int(1e6 * 0.9**i)) for i in range(50)] + [(f"w{i}", 3) for i in range(100)], "word string, c long")
    some = lattice_lm.frequent_words(words, 1000, 30_000).toPandas()
    assert 0 < len(some) <= 30 and some["word"].str.len().sum() <= 30_000
    assert lattice_lm.frequent_words(words, 1000).count() == 150 and lattice_lm.frequent_words(words, 0).count() == 0


def test_long_texts_do_not_look_alike(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(30_000))
    train = spark.createDataFrame([(make("abcdefgh"), "a") for _ in range(4)] + [(make("efghijkl"), "b") for _ in range(4)], "text string, lang string")
    docs = spark.createDataFrame([(0, make("abcdefgh")), (1, make("efghijkl"))], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(train)).collect()}
    assert got[0][0] == "a" and got[1][0] == "b" and min(got[0][1], got[1][1]) > 0.8


# ---- LM ---------------------------------------------------------------------------------------


def segmentations(word, pieces):
    """All ways to write a word as pieces; a character outside the vocabulary as its bytes (None)."""
    if not word:
        yield ()
        return
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield (word[:k], *rest)
    if word[0] not in pieces:
        for rest in segmentations(word[1:], pieces):
            yield (len(word[0].encode()), *rest)


def test_lm_query_equals_the_sum_over_segmentations(spark, tmp_path):
    texts = ["the cat sat", "The thé cat", "a cat at the mat", "dog é 漢 the", "", None, "sat\x0bmat  the", "unseen words here", "the cat sat"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(2, "a cat again", None)]
    folder = written(spark, tmp_path, rows)
    tok = lambda s: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    train = [t for i, t, _ in rows if held(i, 10)]
    counts = Counter(w for t in train for w in tok(t))
    names, p = lattice_lm.vocabulary(registry.piece_model())
    index = {n: k for k, n in enumerate(names)}
    every = {w: list(segmentations("▁" + w, index)) for w in counts}
    prob = lambda s, p: math.prod(p[index[x]] if isinstance(x, str) else (p[-1] / 256) ** x for x in s)
    for _ in range(lattice_lm.ROUNDS):
        expected = np.full(len(p), lattice_lm.SMOOTH)
        for w, c in counts.items():
            weights = [prob(s, p) for s in every[w]]
            for s, q in zip(every[w], weights, strict=True):
                for x in s:
                    if isinstance(x, str):
                        expected[index[x]] += c * q / sum(weights)
                    else:
                        expected[-1] += c * x * q / sum(weights)
        total, p = expected.sum(), expected / expected.sum()
    end = len(train) / (len(train) + total)
    final = np.append(p[:-1] * (1 - end), p[-1] * (1 - end))
    score = lambda t: (sum(math.log(sum(prob(s, final) for s in segmentations("▁" + w, index))) for w in tok(t)) + math.log(end)) / math.log(10)
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in registry.op6_lm_scoring(spark, folder).collect())
    want = sorted((str(i), round(score(t), 4)) for i, t, _ in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-3)
    none = registry.documents(spark, folder).limit(0)
    assert lattice_lm.score(none, none, registry.piece_model()).count() == 0


def test_fragments_do_not_change_scores(monkeypatch):
    rng = random.Random(1)
    names, p = lattice_lm.vocabulary(registry.piece_model())
    pieces, byte = lattice_lm.Pieces(names, np.log(p[:-1])), math.log(p[-1] / 256)
    words = ["".join(rng.choice("abcdethe漢字語é🙂") for _ in range(n)) for n in (1, 30, 70, 200, 700)] + ["the" * 300, "the" * 300]
    times = np.array([1.0, 2, 3, 4, 5, 6, 7])
    cut = lattice_lm.word_scores(words, pieces, byte), lattice_lm.expected_counts(words, times, pieces, byte)
    monkeypatch.setattr(lattice_lm, "LONG", 10**9)
    monkeypatch.setattr(lattice_lm, "STEPWISE", 10**9)
    whole = lattice_lm.word_scores(words, pieces, byte), lattice_lm.expected_counts(words, times, pieces, byte)
    assert np.allclose(cut[0], whole[0]) and np.allclose(cut[1], whole[1])


def test_unsegmented_texts(spark, tmp_path):
    """Texts without spaces, each of which is one word: ids as the library's, scores in bounded steps."""
    import sentencepiece

    rng = random.Random(6)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(20_000)) for _ in range(20)] + ["x" * 100_000]
    folder = written(spark, tmp_path, [(i, t, None) for i, t in enumerate(texts)])
    library = sentencepiece.SentencePieceProcessor(model_proto=registry.piece_model())
    ids = {r.doc_id: r.n_tokens for r in registry.op5_sentencepiece(spark, folder).collect()}
    assert all(ids[i] == len(library.encode(t)) + 2 for i, t in enumerate(texts))
    assert all(math.isfinite(r.score) and r.n_tokens == 2 for r in registry.op6_lm_scoring(spark, folder).collect())
    table = spm.WordTable(spm.MergeModel(registry.piece_model()))
    spm.encode_block(texts, table)
    assert table.size < spm.KEEP_BYTES and len(table) < 10 and not table.long


# ---- names, ties, scratch ---------------------------------------------------------------------


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y")], "slot long, text string, __quality string")
    assert sorted(r.shard for r in sharding.assign(df, "slot", ["a"], 13).collect()) == ["a", "a"]
    assert quality.measure(df).select("__quality").distinct().count() == 2
    encoded = spm.encode(df.withColumnsRenamed({"slot": "ids", "__quality": "n_tokens"}), registry.piece_model(), keep=("ids", "n_tokens"))
    assert encoded.columns == ["ids", "n_tokens", "n_differ"] and encoded.count() == 2


def test_decontamination_with_equally_rare_words(spark):
    item = "aa bb cc dd ee ff gg hh ii jj"
    docs = spark.createDataFrame([(i, f"{x} {item} {x}") for i, x in enumerate(["k", "l", "aa", "jj"])] + [(9, "aa bb cc")], "doc_id long, text string")
    found = decontam.decontaminate(docs, spark.createDataFrame([(1, item), (2, item)], "item_id long, text string"))
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()} == {**{i: (10, ["1", "2"]) for i in range(4)}, 9: (0, [])}


def test_decontamination_of_a_document_full_of_one_word(spark):
    """Alignments of one text with one item are one row, whatever their number."""
    docs = spark.createDataFrame([(1, "go " * 3000), (2, "stop"), (3, "go go go go go go go go go go now")], "doc_id long, text string")
    found = decontam.decontaminate(docs, spark.createDataFrame([(1, "go " * 12), (2, "go now")], "item_id long, text string"))
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()} == {1: (3000, ["1"]), 2: (0, []), 3: (11, ["1", "2"])}


def test_pipeline_leaves_no_scratch_tables(spark):
    shared_folder = Path(shared.scratch_dir(spark))
    before = set(shared_folder.iterdir()) if shared_folder.exists() else set()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    left = [p for p in set(shared_folder.iterdir()) - before if p.is_dir()]
    assert len(left) == 1 and [p.name for p in left[0].iterdir() if p.is_dir()] == ["sentencepiece"]


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    prose = " ".join(f"the word{i} of item{i} and" for i in range(30))
    rows = [(1, prose, "en"), (1, prose, "en"), (None, prose, None), (2, None, None), (3, "", None), (None, "other " + " ".join(f"in w{i} is" for i in range(40)), None), (4, "of " * 50_000, None)]
    folder = written(spark, tmp_path, rows)
    spark.createDataFrame([(1, "nothing of this stands anywhere in any of these texts at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["None", "None"]  # of the three copies the least id, null, stays
    own = {"id": "x", "h": "1", "row": "y", "kept": "0", "class": "", "n_words": "2", "own": "o", "others": "p", "doc": "d", "a.b": "e", "hit_id": "f", "hit_h": "g"}
    own |= {f"__{c}": f"mine {c}" for c in ("h", "doc", "id", "row", "text", "ranges", "ids", "quality", "0", "1", "2")}
    clash = registry.documents(spark, folder).withColumns({c: F.lit(v) for c, v in own.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, folder)
        rows = out.collect()
        assert out.columns == clash.columns and out.dtypes == clash.dtypes and rows, name
        assert all(r[c] == v for r in rows for c, v in own.items()), name
    assert corpus_pipeline.STAGES[-1][1](spark, clash, folder).count() == clash.count()
    bare = clash.select("doc_id", "text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, bare, folder).columns == ["doc_id", "text"], name


def test_tree_sum_in_levels(spark, tmp_path):
    rows = [(k, part, np.array([k, part, 1], "i8").tobytes()) for k in range(3) for part in range(150)]
    df = spark.createDataFrame(rows, "key int, part long, n binary")
    got = {r.key: np.frombuffer(r.n, "i8").tolist() for r in shared.tree_sum(df, "key", {"n": "i8"}, fan=4).collect()}
    assert got == {k: [150 * k, sum(range(150)), 150] for k in range(3)} and shared.tree_sum(df.limit(0), "key", {"n": "i8"}).count() == 0
    assert list(itertools.islice(got, 3))


@pytest.mark.parametrize("many", [0, 2, 100])
def test_substring_extension_and_hot_seeds(spark, many):
    """A passage cut at many places: seeds that stand in many different stretches."""
    from tests.llm.test_substring_decontam import brute_substring, frame
    from trellis.llm import substring

    rng = random.Random(many)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):
        a, b = sorted(rng.sample(range(61), 2))
        rows.append((i, " ".join([f"x{rng.randrange(5)}" for _ in range(rng.randint(0, 9))] + passage[a:b] + [f"y{rng.randrange(5)}" for _ in range(rng.randint(0, 9))])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame(spark, rows).repartition(4), digest=True, many=many).collect()}
    assert got == brute_substring(rows, 20)
