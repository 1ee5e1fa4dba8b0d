"""The trie of conversation prefixes against a plain version: odd turns, long and repeated conversations, names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trellis.llm import prefix_trie as P
from trellis.llm import shared

ROWS = "conv_id long, turn long, role string, text string, d long, name string, conv int, key string, i int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, "k", 3) for r in rows], ROWS)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, ends, parts = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                parts[tuple(v[: d - 1])].add(tuple(v[:d]))
        ends[tuple(v)].append(c)
    leaves, saved = Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in parts[node]) or 1
        saved[node] = sum(saved[x] for x in parts[node]) + (len(members[node]) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(parts[n]), leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def got(docs):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in P.trie(docs).collect())


def made_up(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 7, 8, 9, 15, 16, 17])):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["a b", "c", "d e f"] if t > 2 else ["hi", "yo there"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made_up(seed)
    want = brute(rows)
    assert len(want) > 200 and got(frame(spark, rows).repartition(6)) == want


def test_odd_turns(spark):
    rows = [
        (0, None, "u", "first"), (0, 5, None, None), (0, 5, "u", "b"), (0, 5, "u", "a"), (0, 5, "u", "a"), (0, -3, "", ""), (1, 0, "u", "own \x0b x"), (1, 1, "u", "y"), (2, 1, None, "z"),
        (25, 0, "u", "no base"), (26, 0, "u", "no base"), (26, 1, "u", "more"), (None, 0, "u", "nobody's"), (None, None, None, None), (-7, 0, "u", "minus"), (-7, 1, "u", "more"), (40, 0, "1:u", "x"), (41, 0, "1", ":ux"),
        (10**15 + 3, 0, "u", "far"), (27, 2**60, "u", "late"), (27, 2**60 + 1, "u", "later"), (27, 1, "u", "w " * 50_000),
    ]
    rows += [(c, t, "u", "same") for c in range(60, 80) for t in range(2)]
    want = brute(rows)
    assert want[0][1] == 0 and got(frame(spark, rows)) == want


def test_long_and_repeated_conversations(spark):
    """Conversations of many stretches of turns, some of them copies, and one alone with far more turns than the others."""
    rng = random.Random(3)
    line = [rng.choice(["x", "y y", "z"]) for _ in range(700)]
    rows = [(c, t, "u", w) for c in (0, 1, 20, 21, 43, 60) for t, w in enumerate(line[: 700 - 3 * c])]
    rows += [(7, t, "u", "again") for t in range(513)] + [(c, 0, "s", "hello") for c in range(100, 400)]
    assert got(frame(spark, rows)) == brute(rows)


def test_equal_turn_numbers(spark):
    """A conversation whose turns all have one number is ordered by role and text."""
    rows = [(0, 1, "u", f"t{k % 50}") for k in range(600)] + [(0, None, "u", f"n{k}") for k in range(300)]
    assert got(frame(spark, rows)) == brute(rows)


def test_empty_tables(spark):
    assert got(frame(spark, [])) == [] and got(frame(spark, [(None, 1, "u", "x")])) == []
    only = got(frame(spark, [(5, 0, "u", "x")]))
    assert only == brute([(5, 0, "u", "x")])


def test_names_are_dense(spark):
    keys = spark.range(5000).select((F.col("id") % 1234).alias("k"), F.lit("x").alias("name2")).repartition(7)
    rows = P.dense_names(keys).collect()
    assert sorted(r.name for r in rows) == list(range(1234)) and len({r.k for r in rows}) == 1234


def test_digests_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    ends = [(d, n, c) for d, n, size in ((0, 0, 1), (3, 1, 500), (3, 2, 7), (3, 3, 8), (9, 1, 90)) for c in random.Random(n).sample(range(-100, 2000), size)]
    found = P.list_digests(spark.createDataFrame(ends, "d long, name long, conv long").repartition(5), ["d", "name"]).collect()
    want = {(d, n): hashlib.sha256(",".join(map(str, sorted(c for x, y, c in ends if (x, y) == (d, n)))).encode()).hexdigest() for d, n, _ in ends}
    assert {(r.d, r.name): r.ends_sha256 for r in found} == want and len(found) == len(want)


def test_only_tables_that_the_result_reads_stay(spark):
    folder = Path(shared.scratch_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    P.trie(frame(spark, made_up(5))).count()
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before if p.is_dir()}
    assert left == {"rebuilt", "sizes", "plans", "paths", "groups", "nodes", "owners"}
