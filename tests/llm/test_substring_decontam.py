"""Substring dedup and decontamination against brute force, with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from trellis.llm import decontam, registry, substring

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()), T.StructField("lo", T.StringType()), T.StructField("row", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def brute_substring(rows, window):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def random_texts(seed, count=60):
    rng = random.Random(seed)
    passage = [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(200)]
    rows = []
    for i in range(count):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at, size, into = rng.randrange(150), rng.randint(1, 60), rng.randint(0, len(words))
            words[into:into] = passage[at : at + size]
        if rng.random() < 0.2:
            words += ["same"] * rng.randint(1, 80)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(count, None), (count + 1, ""), (count + 2, rows[3][1]), (count + 3, rows[3][1]), (count + 4, "x " * 30_000), (count + 5, "é ü " * 40)]
    return rows


@pytest.mark.parametrize("seed,window,run", [(1, 20, 8), (2, 6, 3), (3, 5, 5), (4, 20, 1)])
def test_substring_matches_brute_force(spark, seed, window, run):
    rows = random_texts(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame(spark, rows), window=window, seed=run, digest=True).collect()}
    assert got == brute_substring(rows, window)


@pytest.mark.parametrize("many,block", [(0, 1), (8, 1), (0, 8 << 20)])
def test_substring_does_not_depend_on_blocks(spark, many, block):
    rows = random_texts(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame(spark, rows).repartition(5), digest=True, many=many, block_bytes=block).collect()}
    assert got == brute_substring(rows, 20)


def test_substring_texts_and_odd_keys(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(None, line), (1, "a  " + line + "\nz"), (1, "other"), (2, line), (2, line), (3, "a\n b")]
    out = substring.dedup(frame(spark, rows), keep=("n", "lo")).collect()
    assert len(out) == 6 and all(r.n == "x" and r.lo == "y" for r in out)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.kept) for r in out)
    assert got == [(-1, line), (1, "a z"), (1, "other"), (2, ""), (2, ""), (3, "a\n b")]
    assert substring.dedup(frame(spark, [])).count() == 0


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_decontam(rows, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in rows:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                got = windows.get(tuple(words[i : i + n]))
                if got:
                    found |= got
                    hit.update(range(i, i + n))
        out.append((doc, len(words), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def run_decontam(spark, rows, items, **more):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return decontam.decontaminate(frame(spark, rows), benchmark, **more)


@pytest.mark.parametrize("seed,limit", [(1, decontam.MAX_WINDOWS), (2, 40)])
def test_decontam_matches_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "don't", "X-Y", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 10, 11, 30])))) for i in range(20)] + [(90, None), (91, "..."), (92, ""), (93, "W1 w2"), (93, "w1 w2")]
    rows = random_texts(seed, 10)
    for i in range(100, 140):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if rng.random() < 0.7:
            words[20:20] = rng.choice(items[:20])[1].upper().split()
        rows.append((i, " ".join(words)))
    rows += [(100, rows[-1][1]), (None, rows[-1][1])]
    got = sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in run_decontam(spark, rows, items, limit=limit).collect()], key=str)
    assert got == brute_decontam(rows, items)


def test_decontam_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "x " + item.replace("epsilon", "epsilon and") + " y"), (2, item.replace("zeta", "other")), (3, "mu kappa alpha"), (4, item)]
    got = {r.doc_id: (r["items"], r["near_items"]) for r in run_decontam(spark, rows, [(7, item)]).collect()}
    assert got == {1: ([], ["7"]), 2: ([], ["7"]), 3: ([], []), 4: (["7"], ["7"])}


def test_decontam_empty_sides(spark):
    assert run_decontam(spark, [], [(1, "a b")]).count() == 0
    for items in ([], [(1, None)]):
        r = decontam.digests(run_decontam(spark, [(1, "a b c")], items)).first()
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (3, 0, 0, False) and r.items_sha256 == hashlib.sha256(b"").hexdigest()


def written(spark, tmp_path, rows, items):
    """A folder of documents and benchmark."""
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_index_serves_other_test_sets_without_the_texts(spark, tmp_path):
    rng = random.Random(12)
    rows = random_texts(3, 60) + [(500 + i, " ".join(f"w{rng.randrange(300)}" for _ in range(200))) for i in range(40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    index = decontam.build_index(spark.read.parquet(f"{tmp_path}/documents.parquet"), block_bytes=5000)
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    for k in range(2):
        words = [words_of(t or "") for _, t in rows[k::7]]
        items = [(i, " ".join(w[k : k + 14])) for i, w in enumerate(words) if w[k:]] + [(99, "not there at all")]
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        got = sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontam.summaries(index.texts, decontam.lookup(index, benchmark)).withColumnRenamed("doc", "doc_id").collect()], key=str)
        assert got == brute_decontam(rows, items) and any(g[2] for g in got)
    assert index.postings.select("block").distinct().count() > 5


def test_long_items_are_cut_into_rounds(spark, monkeypatch):
    """One item far longer than a round's limit; no round is empty and none is above the limit."""
    rng = random.Random(2)
    long = [f"t{rng.randrange(3000)}" for _ in range(12_000)]
    items = [(1, " ".join(long)), (2, "a b c")]
    rows = [(1, "x " + " ".join(long[4990:5030]) + " y a b c"), (2, " ".join(long[11_980:])), (3, " ".join(long[0:10])), (4, " ".join(long[:3000] + long[2000:]))]
    pieces = decontam.items(spark.createDataFrame(items, "item_id long, text string"))
    parts = decontam.rounds(pieces, 2500)
    sizes = [p.agg({"n": "sum"}).first()[0] for p in parts]
    assert all(sizes) and max(sizes) <= 5000 and sum(sizes) == 12_000 - 9 + 1 and pieces.agg({"n": "max"}).first()[0] <= decontam.PIECE
    got = sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in run_decontam(spark, rows, items, limit=2500).collect()], key=str)
    assert got == brute_decontam(rows, items)


def test_posting_lists_round_trip():
    rng = np.random.default_rng(3)
    for n, terms in ((0, 1), (1, 1), (500, 7), (300_000, 3), (200_000, 150_000)):
        words = rng.integers(0, terms, n).astype(np.uint64)
        if n > 200_000:
            words[1000:280_000] = 9  # steps of more than 16 bits for the others
        found, counts, values, at = decontam.packed(words)
        lists = pa.chunked_array([pa.array([values[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())])
        positions, sizes = decontam.unpacked(lists)
        assert sizes.tolist() == counts.tolist() and len(positions) == n
        again = np.zeros(n, np.uint64)
        again[positions] = np.repeat(found, sizes)
        assert np.array_equal(again, words)


def test_query_and_stage_find_near_matches(spark, tmp_path):
    item = [f"w{i}" for i in range(40)]
    near = " ".join("w0" if i % 10 == 5 else w for i, w in enumerate(item))  # every tenth word changed
    folder = written(spark, tmp_path, [(1, near), (2, " ".join(item)), (3, "nothing of it"), (4, None)], [(7, " ".join(item))])
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r.n_near_items) for r in registry.op2_near_matches(spark, folder).collect()}
    assert got == {1: (0, 0, False, 1), 2: (40, 1, True, 1), 3: (0, 0, False, 0), 4: (0, 0, False, 0)}
    kept = corpus_pipeline.decontamination(spark, registry.documents(spark, folder), folder)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def brute_near(text, item, window=10, slack=2, share=0.8):
    """A window of the item with a share of its terms within slack of one shift."""
    words, terms = words_of(text), words_of(item)
    size = min(window, len(terms))
    for start in range(len(terms) - size + 1):
        for shift in range(-len(terms) - slack, len(words) + slack + 1):
            there = sum(any(0 <= shift + k + off < len(words) and words[shift + k + off] == terms[k] for off in range(-slack, slack + 1)) for k in range(start, start + size))
            if there >= share * size:
                return True
    return False


def test_proximity_matches_brute_force(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    items, rows = [], []
    for i in range(25):
        words = [rng.choice(common) for _ in range(rng.choice([5, 10, 10, 12, 25]))]
        words[rng.randrange(len(words))] = f"name{i}"  # in no text, or in few
        items.append((i, " ".join(words)))
        for k in range(4):
            copy = [f"new{i}" if w.startswith("name") and k < 2 else w for w in words]
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(common)], ["odd", "odd"]])
            rows.append((4 * i + k, " ".join(["pad"] * rng.randint(0, 3) + copy + [rng.choice(common)] * rng.randint(0, 3))))
    want = {d: sorted(str(i) for i, t in items if brute_near(text, t)) for d, text in rows}
    got = {r.doc_id: r.near_items for r in run_decontam(spark, rows, items).collect()}
    assert got == want and sum(map(bool, want.values())) > 40


def test_items_without_an_id(spark):
    one, two = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    rows = [(1, one), (2, two + " x " + one), (3, "c d"), (4, "e f g")]
    found = run_decontam(spark, rows, [(None, one), (None, two), (5, two), (6, "e f g")]).collect()
    assert {r.doc_id: (r.n_hit, r["items"], r.near_items) for r in found} == {1: (12, [None], [None]), 2: (24, [None, "5"], [None, "5"]), 3: (0, [], []), 4: (3, ["6"], ["6"])}
    shown = decontam.digests(run_decontam(spark, rows[:2], [(None, one), (5, two)])).collect()
    assert {r.doc_id: (r.n_items, r.items_sha256) for r in shown} == {1: (1, hashlib.sha256(b"").hexdigest()), 2: (2, hashlib.sha256(b"5").hexdigest())}


def test_repeated_row_keeps_its_text(spark):
    line = " ".join(f"w{i}" for i in range(40))
    out = substring.dedup(frame(spark, [(1, line), (1, line), (2, "a b")]).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in out) == [(1, 0, line), (1, 0, line), (2, 0, "a b")]


def test_stage_removes_rows_not_ids(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(12))
    folder = written(spark, tmp_path, [(1, item), (1, "clean one"), (None, item + " x"), (None, "clean two"), (2, None)], [(7, item)])
    kept = corpus_pipeline.decontamination(spark, registry.documents(spark, folder), folder).collect()
    assert sorted(str(r.text) for r in kept) == ["None", "clean one", "clean two"]
