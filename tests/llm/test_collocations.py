"""Collocations against a plain version: pruning with full and sparse bitmaps, ties, covers, odd cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import collocations as C
from trellis.llm import registry

DOCS = "doc_id long, text string, lang string, a long, phrase string, n string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 7, "p", "q", 1) for i, (t, x) in enumerate(rows)], DOCS)


def brute(rows, floor, longest=4, cover=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: a for k, a in f.items() if a >= floor}
    longer = Counter()
    for (lang, p), a in f.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                key = (lang, p[i : i + size])
                longer[key] = max(longer[key], a)
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * longer[lang, p] < cover * a:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def got(docs, top=2000, **how):
    return sorted(tuple(r) for r in C.top(C.collocations(docs, **how), top).collect())


def made_up(seed, n=300):
    rng = random.Random(seed)
    words = ["ab", "AB", "c", "d", "é", "漢字", "x-y", "zz", "q1", "$"]
    rows = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 60)):
            t += rng.choice(words[: rng.randint(2, 10)]) + rng.choice([" "] * 9 + ["  ", "\t", ". ", "\n", "!", ";,"])
        rows.append((t, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("bits", [64, 1 << 12, None])
def test_equals_brute_force(spark, bits):
    """With few bits nearly every bucket is full; the results are the same."""
    rows = made_up(1)
    want = brute(rows, 12)
    assert len(want) > 100 and got(frame(spark, rows).repartition(5), floor=12, bits=bits) == want


def test_blocks_and_the_first_few(spark, monkeypatch):
    rows = made_up(2)
    monkeypatch.setattr(C, "BLOCK_BYTES", 300)
    monkeypatch.setattr(C, "CELLS", 100)
    want = brute(rows, 8, top=5)
    assert got(frame(spark, rows), top=5, floor=8) == want and max(r[1] for r in want) == 5


def test_longer_phrases_and_covers(spark):
    rows = [("the red fox runs far. the red fox", "en")] * 40 + [("red fox sleeps", "en")] * 5 + [("a b a b a b", "en")] * 30
    for longest in (2, 3, 4):
        for cover in (50, 80, 100, 101):
            assert got(frame(spark, rows), longest=longest, cover=cover) == brute(rows, 30, longest, cover)


def test_odd_cases(spark):
    odd = [(None, "en"), ("", "en"), (" \t", None), (".!?", "de"), ("one", "fr"), ("Nul\x00 b\x85yte " * 40, "es"), ("w " * 200_000, "en"), ("x" * 300_000, "en")]
    assert got(frame(spark, odd)) == brute(odd, 30)
    assert C.collocations(frame(spark, odd[:5])).count() == 0 and got(frame(spark, [])) == []
    assert C.top(C.collocations(frame(spark, odd).drop("a", "n"))).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_beyond_64_bits(spark):
    """The products are decimals; the quotient fits."""
    a = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "x", a), ("en", "y", a + 1), ("en", "x y", a)], "lang string, phrase string, a long")
    keep, C.frequent = C.frequent, lambda *_: (counts, spark.createDataFrame([("en", 3 * a)], "lang string, n long"))
    try:
        row = C.collocations(counts).first()
    finally:
        C.frequent = keep
    assert row.score == 2000000 * a // (2 * a + 1) == 999999


def test_bitmap_has_the_bits_of_its_cells(spark):
    cells = [0, 1, 7, 8, 32767, 32768, 70_000, 131_071]
    bits = np.frombuffer(C.bitmap(spark.createDataFrame([(c,) for c in cells], "cell long"), 1 << 17), np.uint8)
    assert np.flatnonzero(C._set(bits, np.arange(1 << 17))).tolist() == cells


def test_passes_count_few_phrases_beside_the_frequent_ones(spark):
    """Of phrases that are rare, hardly any reach the exact counts of the second pass."""
    rng = random.Random(5)
    rows = [("the cat sat " + " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(30)), "en") for _ in range(400)]
    docs = frame(spark, rows).select(F.lit("en").alias("lang"), "text")
    level = {}
    for floor in (1, 30):
        counts = docs.transform(C.by_batches, C._pass(1, 4, 1 << 20, None), C._ROWS).groupBy("lang", "phrase", "cell").agg(F.sum("n").alias("n")).where(f"n >= {floor} AND cell >= 0")
        maps = spark.sparkContext.broadcast((C.bitmap(counts.where("lang IS NULL"), 1 << 20), C.bitmap(counts.where("phrase IS NOT NULL"), 1 << 20)))
        level[floor] = docs.transform(C.by_batches, C._pass(2, 4, 1 << 20, maps), C._ROWS).where("phrase IS NOT NULL").select("phrase").distinct().count()
    assert level[30] < 40 < 5000 < level[1]


def test_the_query_has_a_rank_without_gaps(spark):
    rows = registry.op12_collocations(spark, "/root/testdata/sf0.001").collect()
    ranks = {}
    for r in rows:
        ranks.setdefault(r["lang"], []).append(r["rank"])
    assert rows and all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
