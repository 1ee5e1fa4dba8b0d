"""Quality rules, sharding and SentencePiece encoding on small cases, against brute force and the library."""

import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm import quality, registry, sharding, spm

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("slot", T.StringType())])
TEXTS = [None, "", " \n\t ", "one two", "a b c a b c", "x x x x x", "the cat sat\n\nthe cat sat\n  \nthe dog\n\n", "é ü ß　wide # $ | <>", "word " * 30_000, "tail\x0bform\x0cfeed\rcr", "the of and a b c d e f g " * 3 + " ".join(f"w{i}" for i in range(60))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_match_brute_force(spark):
    got = {r.doc_id: r for r in quality.measure(frame(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert got[10].kept


def test_quality_keeps_columns_and_empty_tables(spark):
    kept = quality.keep_good(frame(spark, TEXTS))
    assert kept.columns == ["doc_id", "text", "kept", "slot"] and [r.doc_id for r in kept.collect()] == [10]
    assert quality.measure(frame(spark, [])).count() == 0


def test_quality_runs_no_python(spark):
    plan = quality.measure(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ExistingRDD", ""))


def test_table_is_full_and_even():
    table = sharding.fill_table(registry.SHARDS)
    sizes = Counter(table)
    assert len(table) == 4099 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill_table(registry.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 31)
    assert moved < 0.1 * len(table)  # few slots of the remaining shards change hands
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"])
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "b"], 4098)


def test_sharding_assigns_every_row(spark):
    df = frame(spark, TEXTS).unionAll(frame(spark, TEXTS)).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    rows = sharding.assign(df, "doc_id", ["a", "b", "c"], 13).collect()
    assert len(rows) == 2 * len(TEXTS) and all(r.shard in "abc" and 0 <= r.slot < 13 for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len(TEXTS)
    table = sharding.fill_table(["a", "b", "c"], 13)
    for r in rows:
        want = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 13
        assert (r.slot, r.shard) == (want, "abc"[table[want]])
    assert sharding.assign(frame(spark, []), "doc_id", ["a"], 13).count() == 0


def test_write_sharded(spark, tmp_path):
    df = sharding.assign(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id", ["a", "b"], 13)
    sharding.write_sharded(df, str(tmp_path / "out"), files_per_shard=3)
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=a", "shard=b"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


ODD = [None, "", " ", "  ", "a  b ▁▁c\n\n x", "☃ é　<s></s> ", "\x00a퟿", " lead", "trail  ", "naïve 漢字 🙂🙂", "The quick brown fox, don't. " * 2000, "x" * 50_000, "\n\n\t."]


def test_spm_equals_the_library(spark):
    import sentencepiece

    model = registry.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    df = frame(spark, ODD)
    got = {r.doc_id: r for r in spm.encode(df, model).collect()}
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(df, model), model).collect()}
    digest = {r.doc_id: r for r in spm.encode_digests(df, model).collect()}
    for i, text in enumerate(ODD):
        want = [1, *library.encode(text or ""), 2]
        assert got[i].ids == want and got[i].n_tokens == len(want) and got[i].n_differ == 0
        assert back[i] == library.decode(want)
        assert digest[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert spm.encode_digests(frame(spark, []), model).count() == 0


def test_spm_on_documents_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=registry.piece_model())
    docs = registry.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registry.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        want = np.array([1, *library.encode(d.text or ""), 2], "<u4")
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()


def test_word_that_differs_takes_the_library_ids():
    model = spm.MergeModel(registry.piece_model())
    table = spm.WordTable(model)
    model.costs.pop("▁the")  # as if our merges went wrong
    out, differ = spm.encode_block(["the cat the", "cat"], table)
    assert np.frombuffer(out[0], "<u4").tolist() == model.library.encode("the cat the") and differ == [2, 0]


def test_words_of_a_task_are_encoded_once(monkeypatch):
    """A task's texts have some hundred thousand different words: those that come again are in the table."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        words = spm.WordTable(spm.MergeModel(f.read()))
    met, cut = [], spm.MergeModel.fragments
    monkeypatch.setattr(spm.MergeModel, "fragments", lambda model, word: met.append(word) or cut(model, word))
    texts = [" ".join(f"{i * 7919 % 999983:x}" for i in range(at, at + 5000)) for at in range(0, 120_000, 5000)]
    for text in [*texts, *texts]:
        spm.encode_block([text], words)
    assert len(met) == len(set(met))


def test_new_words_of_a_block_are_encoded_together(monkeypatch):
    """No word of usual length has an agenda of its own, and the library is not asked word by word."""
    table = spm.WordTable(spm.MergeModel(registry.piece_model()))
    library, met, asked = table.model.library, [], []
    whole = [" ".join(f"w{i * 7919 % 999983:x}é☃" for i in range(at, at + 1000)) + "  " for at in range(0, 5000, 1000)]
    want = [np.array(library.encode(t), "<u4").tobytes() for t in whole]
    monkeypatch.setattr(spm.MergeModel, "merge", lambda model, symbols: met.append(symbols))
    monkeypatch.setattr(table.model, "library", SimpleNamespace(encode=lambda texts, **more: asked.extend(texts) or library.encode(texts, **more)))
    assert spm.encode_block(whole, table) == (want, [0] * 5)
    assert not met and len(asked) < 200 and sum(map(len, asked)) > 40_000


def test_matrix_of_agendas_equals_the_agenda_of_each_word():
    """Characters in no piece, lengths from 1 to the longest, and equal scores (the leftmost pair goes first)."""
    rng = random.Random(5)
    letters = "etaonrish" * 3 + "ABC.,;:!\n\t\x00\x7f0123éßñ漢字かな한글☃🙂\U0010ffff"
    words = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 9, 14, 63]))) for _ in range(3000)]
    words = [spm.MARK * rng.choice([0, 1, 1, 1, 2]) + w for w in words]
    words = [w[: spm.SHORT] for w in words if w] + ["e" * spm.SHORT, "🙂" * spm.SHORT]
    for step in (1, 500, 10**6):
        model = spm.MergeModel(registry.piece_model())
        model.costs = {p: cost // step for p, cost in model.costs.items()}
        assert model.merge_words(words) == [spm.packed_ids(model.merge(w)) for w in words]
    assert model.merge_words([]) == []
