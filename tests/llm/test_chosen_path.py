"""The Jaccard join against brute force: nulls, ties, short and long texts, large near groups."""

import random
import re

import pytest
from pyspark.sql import types as T

from trellis.llm import chosen_path
from trellis.llm.components import components
from trellis.llm.shared import materialise

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("h", T.StringType()), T.StructField("id", T.StringType()), T.StructField("class", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, threshold):
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        copies = [j for j in ids if sets[j] == sets[i] and sets[i]] or [i]
        out[i] = (min(seen), min(copies), len(links[i]))
    return out


def some_texts(seed, near_group=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    rows = []
    for _ in range(40):
        words = [word() for _ in range(rng.randint(1, 150))]
        rows.append(words)
        for _ in range(rng.randint(0, 4)):
            other = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                other[rng.randrange(len(other))] = word()
            rows.append(other)
    base = [word() for _ in range(300)]
    for _ in range(near_group):
        other = list(base)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(300)] = word()
        rows.append(other)
    rng.shuffle(rows)
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    n = len(out)
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "one  two"), (n + 5, "one"), (n + 6, "word " * 40_000)]


@pytest.mark.parametrize("seed,near,how", [(1, 0, {}), (2, 150, {}), (3, 150, {"leaf": 8, "side": 16, "leaf_side": 32}), (4, 0, {"threshold": 0.6})])
def test_join_matches_brute_force(spark, seed, near, how):
    rows = some_texts(seed, near)
    want = brute(rows, how.get("threshold", 0.8))
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in chosen_path.classes(frame(spark, rows), **how).collect()}
    assert got == want


def test_repeated_ids_and_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (1, text), (1, text), (1, "other words here and there"), (2, text + " more"), (3, None), (4, None)]
    kept = chosen_path.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "h", "id", "class"]
    assert sorted(str((r.doc_id, (r.text or "")[:5])) for r in kept.collect()) == sorted(map(str, [(None, "w0 w1"), (1, "other"), (3, ""), (4, "")]))
    assert chosen_path.classes(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (150, 300), (5, 5), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 150, 200, 300)} == {100} and len(got) == 65
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_follow_the_target():
    assert chosen_path.runs_for(0.9, 0.8) < chosen_path.runs_for(0.999, 0.8) < 30


def test_recall_of_contained_texts_at_full_depth(spark):
    rows = []
    for i in range(4000):  # one text in a longer one: 96 of 120 grams, in no other text
        words = [f"p{i}w{j}" for j in range(124)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:100]))]
    runs = chosen_path.runs_for(chosen_path.TARGET_RECALL, 0.8)
    keyed = chosen_path._keyed(frame(spark, rows), "doc_id", "text")
    # leaf=1: each node is split to the last level, as the nodes of a hot template are
    features = materialise(keyed.select("doc", "h", "text").mapInArrow(chosen_path._features(chosen_path.GRAM, 0.8, runs), chosen_path._FEATURES), "features")
    found = chosen_path.candidate_links(features, features.select("id"), runs, leaf=1)
    assert found.count() >= 3996  # 0.9999 of them are expected
