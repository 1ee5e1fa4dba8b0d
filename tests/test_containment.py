"""Containment of results against an exhaustive matching; components against union and find."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.operators import containment as C
from trellis.operators.components import components


def brute(gold, found):
    """Size of a maximum matching by augmenting paths, row by row."""
    need, have = [Counter(g) for g in gold], [Counter(f) for f in found]
    fits = [[j for j, h in enumerate(have) if not n - h] for n in need]
    owner = {}

    def place(i, tried):
        for j in fits[i]:
            if j not in tried:
                tried.add(j)
                if j not in owner or place(owner[j], tried):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(need)))


def made_up(seed):
    """Many pairs of results: key, rows of cells."""
    rng = random.Random(seed)
    gold, found = [], []
    for key in range(60):
        words = "abcdefgh"[: rng.randint(1, 8)]
        gold += [(key, [rng.choice(words) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(0, 9))]
        found += [(key, [rng.choice(words) for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(0, 9))]
    gold += [(None, ["a"]), (None, ["a", "a"])]
    found += [(None, ["a", "b"]), (None, ["b", "a", "a"])]
    return gold, found


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_brute_force(spark, seed):
    gold, found = made_up(seed)
    frames = [spark.createDataFrame(x, "k int, cells array<string>").select("k", C._numbered(C.F.col("cells")).alias("cells")).repartition(3) for x in (gold, found)]
    got = {r.k: (r.n_gold, r.n_found, r.n_matched, r.contained) for r in C.matches(*frames, ["k"]).collect()}
    of = lambda rows, k: [c for x, c in rows if x == k]
    want = {}
    for k in {k for k, _ in gold + found}:
        g, f = of(gold, k), of(found, k)
        m = brute(g, f)
        want[k] = (len(g), len(f), m, len(g) == len(f) == m)
    assert got == want and any(w[3] for w in want.values())


def test_typed_rows(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    gold = frame([(1, ["a", "b"]), (None, ["c"])], "x int, v array<string>")
    assert C.contained(gold, frame([("more", ["b", "a"], 1.0), ("more", ["c"], None)], "m string, v array<string>, y double"))
    assert not C.contained(gold, frame([(1, ["a", "b", "b"]), (None, ["c"])], gold.schema)) and C.contained(gold, frame([(1, ["a", "b", "b"]), (None, ["c"])], gold.schema), as_set=True)
    assert not C.contained(gold, gold.limit(1)) and not C.contained(gold, gold.unionAll(gold.limit(1)))
    assert C.contained(gold.limit(0), gold.limit(0)) and not C.contained(gold.limit(0), gold)
    assert C.contained(frame([("a",), ("a",)], "x string"), frame([("a", "b"), ("c", "a")], "x string, y string"))  # as many rows, each with an a
    assert not C.contained(frame([("a", "a")], "x string, y string"), frame([("a", "b")], "x string, y string"))


def test_very_many_equal_rows_are_one_class(spark):
    rows = spark.range(50_000).selectExpr("'same' AS x", "id % 2 AS y")
    assert C.contained(rows.select("x"), rows.select("y", "x"))
    got = C.matches(C.rows_of(rows.selectExpr("'k' AS k", "x"), ["k"]), C.rows_of(rows.where("y = 0").selectExpr("'k' AS k", "y", "x"), ["k"]), ["k"]).first()
    assert (got.n_gold, got.n_found, got.n_matched) == (50_000, 25_000, 25_000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=6), st.data())
def test_maximum_flow_equals_matching_of_single_rows(left, right, data):
    edges = sorted(data.draw(st.sets(st.tuples(st.integers(0, len(left) - 1), st.integers(0, len(right) - 1)))))
    flow = C._maximum(dict(enumerate(left)), dict(enumerate(right)), edges)
    singles_l = [u for u, n in enumerate(left) for _ in range(n)]
    singles_r = [v for v, n in enumerate(right) for _ in range(n)]
    owner = {}

    def place(i, tried):
        for j, v in enumerate(singles_r):
            if (singles_l[i], v) in set(edges) and j not in tried:
                tried.add(j)
                if j not in owner or place(owner[j], tried):
                    owner[j] = i
                    return True
        return False

    assert sum(flow.values()) == sum(place(i, set()) for i in range(len(singles_l))) and all(0 <= flow[u] <= n for u, n in enumerate(left))


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(700)] + [(9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    least = {}
    for x in parent:
        least[find(x)] = min(least.get(find(x), x), x)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: least[find(x)] for x in parent}


@pytest.mark.parametrize("empty", [False, True])
def test_the_empty_text_is_looked_up_only_for_rows_without_cells(spark, monkeypatch, empty):
    """It would stand in every row, and be the greatest group of all joins."""
    kept, keep = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: kept.append((name, keep(df, name))) or kept[-1][1])
    frame = lambda rows: spark.createDataFrame(rows, "cells array<string>").select(C._numbered(C.F.col("cells")).alias("cells"))
    row = C.matches(frame([(["a"],), (["b"],)] + [([],)] * empty), frame([(["a", "x"],), (["b"],), (["y"],)]), []).first()
    assert (row["n_gold"], row["n_found"], row["n_matched"], row["contained"]) == (2 + empty, 3, 2 + empty, empty)
    assert any("" in r["cells"] for r in dict(kept)["classes"].collect()) == empty
