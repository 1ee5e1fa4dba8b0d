"""Names by a trie and vectors by pivots, against comparing everything with everything."""

import random
import re

import numpy as np
import pytest

from trellis.operators import pivots
from trellis.operators import retrieval as R


def test_names_that_begin_alike(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "Éta", "x1", "du", "O'Neil"]
    names = list({rng.choice(["Team ", "Team-", "le "]) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)}) + ["Team", "Team Alpha", "ab", "Team (x"]
    texts = [(i, " ".join(rng.choice([*names, *words, "team", "TEAM-", "…"]) for _ in range(rng.randint(0, 9)))) for i in range(120)] + [(200, None), (201, ""), (202, "team alpha" + "s"), (203, "TEAM ALPHA")]
    got = {(r.k, r.name) for r in R.entity_mentions(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "k", cap=None).collect()}
    whole = lambda n, t: re.search(rf"(?iu)(?<!\w){re.escape(n)}(?!\w)", t)
    fit = [n for n in names if len(n) >= 3 and re.fullmatch(r"\w(.*\w)?", n)]
    assert got == {(k, n) for k, t in texts if t for n in fit if whole(n, t)} and len(got) > 100


@pytest.mark.parametrize("sent", [0, 10**6])
def test_a_first_word_that_all_names_share(spark, monkeypatch, sent):
    """Work follows the texts: a place of a text meets one node of a depth, however many names start alike."""
    monkeypatch.setattr(R, "SENT_NODES", sent)
    names = spark.range(20_000).selectExpr("concat('Item ', id) AS name")
    texts = spark.range(3_000).selectExpr("id AS k", "concat('the item ', id * 9, ' or item', id, ' and ITEM  ', id) AS text")
    rows = R.entity_mentions(texts, names, "k", cap=None)
    assert rows.count() == sum(9 * i < 20_000 for i in range(3_000))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_names_or_texts(spark):
    none = spark.createDataFrame([], "name string")
    texts = spark.createDataFrame([(1, "a b")], "k int, text string")
    assert R.entity_mentions(texts, none, "k").count() == 0 and R.entity_mentions(texts, none, "k").columns == ["k", "name", "place"]
    assert R.entity_mentions(texts.limit(0), spark.createDataFrame([("a b c",)], "name string"), "k").count() == 0


def clusters(seed, n=1200, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, size)) * 10
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, size)) * 0.3
    x[5:40] = x[5]  # equal vectors: ties go to the key
    return x.astype(np.float32)


@pytest.mark.parametrize("k,count", [(1, None), (7, 12), (60, 5), (2000, None)])
def test_pivots_find_what_comparing_all_finds(spark, tmp_path, k, count):
    x = clusters(k)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)]
    table = pivots.store(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), str(tmp_path / "p"), count=count)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1200, 100)] + [(5000, [0.0] * 8), (5001, None)], "query_id long, embedding array<float>")
    found = pivots.nearest(table, queries, k, block=5)
    got = {}
    for r in found.rows.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.distance))
    for q, v in [(i, x[i]) for i in range(0, 1200, 100)] + [(5000, np.zeros(8))]:
        d = ((x.astype(float) - np.asarray(v, float)) ** 2).sum(1).round(6)
        order = sorted(range(len(x)), key=lambda i: (d[i], i))[:k]
        mine = sorted(got[q])
        assert [m[1] for m in mine] == order and np.allclose([m[2] for m in mine], d[order], atol=2e-6)
    assert 5001 not in got
    if k <= 7:
        assert found.pairs_read < 0.5  # clustered vectors: most cells are excluded


def test_pivots_of_no_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    table = pivots.store(empty, str(tmp_path / "p"))
    assert pivots.nearest(table, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"), 3).rows.count() == 0


def test_cells_that_are_not_needed_are_not_read(spark, tmp_path):
    x = clusters(2)
    table = pivots.store(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), str(tmp_path / "p"))
    found = pivots.nearest(table, spark.createDataFrame([(0, x[0].tolist())], "query_id long, embedding array<float>"), 3)
    assert found.rows.count() == 3 and found.cells_read < 0.5


def listed(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    return got


@pytest.mark.parametrize("k", [1, 6, 3000])
def test_batch_in_squares_finds_what_comparing_all_finds(spark, monkeypatch, k):
    """Many squares, equal vectors beyond k, and vectors that have no distance: these come last, as in SQL."""
    from trellis.operators import squares

    monkeypatch.setattr(squares, "SIDE", 300)
    monkeypatch.setattr(squares, "PAIRS", 700)
    x = clusters(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-9, None), (9001, [1.0]), (9002, [None] * 8)]
    queries = [(i, x[i].tolist()) for i in range(0, 1200, 100)] + [(5000, [0.0] * 8), (5001, None)]
    schema = "array<float>"
    got = listed(R.top_k_batch(spark.createDataFrame(rows, f"vec_id long, embedding {schema}"), spark.createDataFrame(queries, f"query_id long, embedding {schema}"), k, max_queries=4, decimals=4).collect())
    assert set(got) == {q for q, _ in queries}
    for q, v in queries[:-1]:
        d = ((x.astype(float) - np.asarray(v, np.float32).astype(float)) ** 2).sum(1)
        mine = got[q]
        assert len(mine) == min(k, len(rows)) and [m for m in mine if m[1] is None] == [(i, None) for i in (-9, 9001, 9002)][: max(0, k - 1200)]
        some = mine[:1200]
        assert np.allclose([m[1] for m in some], np.sort(d)[:k], atol=6e-5) and np.allclose(d[[m[0] for m in some]], [m[1] for m in some], atol=6e-5)
        assert [(m[1], m[0]) for m in some] == sorted((m[1], m[0]) for m in some)
        assert all(m[0] <= 39 for m in some[:k] if m[1] == 0 and q == 5)
    assert got[5001] == [(i, None) for i, _ in sorted(rows)][:k]


def test_squares_round_as_sql(spark):
    from trellis.operators.squares import rounded

    x = np.array([0.00005, 1.00005, 2.00015, 0.12345, 1.23445, 7.00000000001, 0.0, np.inf])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(R.F.round("x", 4)).collect()]
    assert rounded(x, 4).tolist() == want


def test_batch_has_no_join_of_all_pairs(spark):
    """No pair of a query and a vector is a row, and no queries are sent to all tasks."""
    v = spark.range(3000).selectExpr("id AS vec_id", "array(cast(id AS float), cast(id % 7 AS float)) AS embedding")
    rows = R.top_k_batch(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 2)
    assert rows.count() == 120 and "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_pivots_take_two_rounds_whatever_the_queries(spark, tmp_path):
    """Jobs do not grow with the blocks of queries."""
    x = clusters(4)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    table = pivots.store(v, str(tmp_path / "p"))
    queries = v.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for block in (240, 4):
        spark.sparkContext.setJobGroup(f"pivots {block}", "")
        found = pivots.nearest(table, queries, 3, block=block)
        rows = listed(found.rows.collect())
        jobs.append(len(tracker.getJobIdsForGroup(f"pivots {block}")))
        assert rows == listed(R.top_k_batch(v, queries, 3).collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] < jobs[0] + 10


def test_squares_with_an_empty_side(spark, monkeypatch):
    from trellis.operators import squares

    monkeypatch.setattr(squares, "SIDE", 1)
    v = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "vec_id long, embedding array<float>")
    got = listed(R.top_k_batch(v, v.withColumnRenamed("vec_id", "query_id"), 2, max_queries=1).collect())
    assert got == {i: sorted([(j, float((i - j) ** 2)) for j in range(6)], key=lambda x: (x[1], x[0]))[:2] for i in range(6)}
