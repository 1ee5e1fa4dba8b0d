"""Selection rules, comparators and metrics."""

import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trellis.operators import evaluation as E
from trellis.operators import fusion as U
from pyspark.sql import functions as F

LIVE = "question_id string, pipeline string, success boolean"
EVIDENCE = "question_id string, pipeline string, evidence_score double, groundedness double, completeness double, relevance double"
PAIRS = "question_id string, c_gt boolean, a_gt boolean, c_gx boolean, a_gx boolean, c_tx boolean, a_tx boolean"
G, T_, X = U.PIPELINES

#: name: (valid, agreements gt gx tx; None: computed but in error, "-": not computed), scores, expected selected, rule, strength
CASES = {
    "all agree": ("gtx", (True, True, True), {G: 0.9, T_: 0.8, X: 0.7}, G, "all_three_agree", "strongest"),
    "stronger third is outside the pair": ("gtx", (True, False, False), {G: 0.5, T_: 0.6, X: 0.9}, T_, "single_pair_agreement", "moderate"),
    "tabular and textual": ("gtx", (False, False, True), {G: 0.9, T_: 0.6, X: 0.7}, X, "single_pair_agreement", "strong"),
    "none agree": ("gtx", (False, False, False), {G: 0.5, T_: 0.6, X: 0.55}, T_, "no_agreement", "none"),
    "two of three": ("gtx", (True, True, False), {G: 0.5, T_: 0.6, X: 0.9}, X, "transitivity_conflict", "conflict"),
    "one valid": ("x", ("-", "-", "-"), {X: 0.1}, X, "only_one_valid", "none"),
    "two valid agree": ("gt", (True, "-", "-"), {G: 0.5, T_: 0.6}, T_, "single_pair_agreement_two_valid", "moderate"),
    "two valid disagree": ("gx", ("-", False, "-"), {G: 0.5, X: 0.6}, X, "no_agreement_two_valid", "none"),
    "all failed": ("", ("-", "-", "-"), {}, None, "all_pipelines_failed", "none"),
    "judge error": ("gtx", (None, None, None), {G: 0.5, T_: 0.6, X: 0.7}, X, "no_agreement", "none"),
    "nothing computed": ("gtx", ("-", "-", "-"), {G: 0.5, T_: 0.6, X: 0.4}, T_, "not_applicable", "none"),
    "two computed, both agree": ("gtx", (True, True, "-"), {G: 0.5, T_: 0.9, X: 0.7}, T_, "single_pair_agreement", "strong"),
    "score missing in the group": ("gtx", (True, False, False), {G: None, T_: 0.2, X: 0.9}, T_, "single_pair_agreement", "moderate"),
    "all scores missing": ("gt", (False, "-", "-"), {G: None, T_: None}, G, "no_agreement_two_valid", "none"),
    "tie down to the order": ("gtx", (False, False, False), {G: 0.5, T_: 0.50004, X: 0.50009}, G, "no_agreement", "none"),
}


@pytest.fixture(scope="module")
def selected(spark):
    live, evidence, pairs = [], [], []
    for name, (valid, agreements, scores, *_) in CASES.items():
        for short, p in zip("gtx", U.PIPELINES, strict=True):
            live.append((name, p, short in valid))
            if p in scores:
                evidence.append((name, p, scores[p], 0.5, 0.5, 0.5))
        pairs.append((name, *[v for a in agreements for v in (a != "-", a if a != "-" else None)]))
    rows = U.select_answers(spark.createDataFrame(live, LIVE), spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(pairs, PAIRS)).collect()
    return {r.question_id: r for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_selection(selected, name):
    r = selected[name]
    assert (r.selected, r.rule, r.strength) == CASES[name][3:]


def test_tie_broken_by_groundedness(spark):
    rows = [("q", G, 0.5, 0.1, 1.0, 1.0), ("q", X, 0.5, 0.9, 0.0, 0.0)]
    assert U.pick_best(spark.createDataFrame(rows, EVIDENCE)).first().pipeline == X


def test_nothing_leaks_into_a_selection(selected):
    assert set(next(iter(selected.values())).asDict()) == {"question_id", "rule", "strength", "independence", "selected"}


#: gold, found, whether they match; lists of (column order aside) rows.
MATCHES = [
    ("names and order of columns", [(1, "a")], [("a", 1)], True), ("order of rows", [(1, "a"), (2, "b")], [(2, "b"), (1, "a")], True),
    ("whole doubles", [(1.0, "a")], [(1, "a")], True), ("a value", [(1, "a")], [(2, "a")], False), ("an extra row", [(1, "a")], [(1, "a"), (1, "a")], False),
    ("values swapped across rows", [(1, "a"), (2, "b")], [(1, "b"), (2, "a")], False), ("a missing column", [(1, "a")], [(1,)], False), ("null", [(None, "a")], [(None, "a")], True),
]


@pytest.mark.parametrize("name,gold,found,same", MATCHES)
def test_unordered_comparison(spark, name, gold, found, same):
    frame = lambda rows: spark.createDataFrame(rows) if not any(v is None for r in rows for v in r) else spark.createDataFrame(rows, "x int, y string")
    assert E.same_result(frame(gold), frame(found)) == same


def test_lists_in_cells(spark):
    a = spark.createDataFrame([(["x", "y", "y"],)], "v array<string>")
    b = spark.createDataFrame([(["y", "x", "y"],)], "w array<string>")
    c = spark.createDataFrame([(["y", "x"],)], "w array<string>")
    assert E.same_result(a, b) and not E.same_result(a, c) and E.same_result(a, c, as_set=True)


def test_ordered_comparison_tells_types_and_columns_apart(spark):
    a, b = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(2, 1)], "a long, b long")
    assert not E.same_result(a, b, columns_matter=True) and E.same_result(a, b)
    assert not E.same_result(a, a.selectExpr("cast(a as double) a", "b"), columns_matter=True)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("ab")), max_size=6), st.lists(st.tuples(st.integers(0, 3), st.sampled_from("ab")), max_size=6))
def test_multiset_equality_is_that_of_sorted_lists(spark, a, b):
    frame = lambda rows: spark.createDataFrame(rows, "x long, y string")
    assert E.same_result(frame(a), frame(b), columns_matter=True) == (sorted(a) == sorted(b))


def test_buckets_and_averages(spark):
    values = [1.0, 0.8, 0.3, 0.05, 0.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(E.bucket(F.col("v"))).collect()] == ["perfect", "high", "mid", "low", "zero", "nan", "nan"]
    assert math.isclose(df.agg(E.average_without_nan(F.col("v"))).first()[0], 2.15 / 5)
    assert df.where("false").agg(E.rate(F.col("v") > 0)).first()[0] is None


def test_evidence_scores(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.5, 2), (None, 0.5, 0.5, None)], "g double, c double, r double, n int")
    got = [r[0] for r in df.select(U.evidence_score(F.col("g"), F.col("c"), F.col("r"), U.execution_quality(F.col("n")))).collect()]
    assert math.isclose(got[0], 0.4 + 0.125 + 0.1 + 0.135) and got[1] is None


def test_every_combination_has_a_rule(spark):
    rows = [(str(i), v[0], v[1], v[2], True, a[0], True, a[1], True, a[2]) for i, (v, a) in enumerate(itertools.product(itertools.product([True, False], repeat=3), itertools.product([True, False, None], repeat=3)))]
    schema = "question_id string, " + ", ".join(f"valid_{p} boolean" for p in U.PIPELINES) + ", c_gt boolean, a_gt boolean, c_gx boolean, a_gx boolean, c_tx boolean, a_tx boolean"
    got = U.agreement_groups(spark.createDataFrame(rows, schema))
    assert got.where("rule is null").count() == 0 and got.where("rule <> 'all_pipelines_failed' and not (in_graph or in_tabular_v2 or in_textual)").count() == 0
