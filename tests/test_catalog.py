"""Every named query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from trellis.operators.graph import Graph
from trellis.plans import catalog, knowledge_base

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None).map(lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module", autouse=True)
def one_knowledge_base(spark):
    """The graph of the question shapes, made once and kept: their plans are then small."""
    made, make = knowledge_base.kb_graph(spark, DIR), knowledge_base.kb_graph
    kept = Graph(made.nodes.coalesce(2).cache(), made.edges.coalesce(2).cache())
    knowledge_base.kb_graph = lambda spark, d: kept
    yield make
    knowledge_base.kb_graph = make
    kept.nodes.unpersist()
    kept.edges.unpersist()


def test_labels_prune_the_scans(spark, one_knowledge_base):
    """A constant label leaves only the tables that have it."""
    plan = one_knowledge_base(spark, DIR).label("Horse")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "s_suppkey" in plan


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["point_lookup"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "o_orderdate" not in plan


def test_no_python_in_the_plans(spark):
    for name in ("selector", "graph_two_hop", "retrieval_merge", "full_diff", "vector_topk_batch"):
        plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("BatchEvalPython", "ArrowEval", "MapInPandas", "MapInArrow")), name
