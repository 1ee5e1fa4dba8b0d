"""A graph on disk: its plans read few folders and exchange little, and its rows are those of the graph in memory."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from trellis.operators import stored_graph as SG
from trellis.operators.graph import Graph
from trellis.plans import graph_queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    name, path = f"g{uuid.uuid4().hex}", str(tmp_path_factory.mktemp("graph") / "g")
    made = SG.save(graph_queries.star_graph(spark, DIR), spark, name, path, buckets=4)
    yield made
    SG.dropped(spark, name, path)
    assert not spark.catalog.tableExists(f"{name}_nodes")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_chain_joins_buckets_without_an_exchange(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stored.chain("r", ("in", "PARTOF", "n"), ("in", "LIVESIN", "c"))
        plan = plan_of(found.table())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    assert re.findall(r"PartitionFilters: \[isnotnull\(type#\d+\), \(type#\d+ = (\w+)\)\]", plan) == ["PARTOF", "LIVESIN"]


def test_labels_and_types_prune_folders(stored):
    for df, folder, n in ((stored.label("Nation"), "label", 1), (stored.label("Nation", "Region"), "label", 2), (stored.edges_of("PLACED", "src"), "type", 1)):
        files = df.inputFiles()
        assert len({re.search(rf"{folder}=(\w+)", f)[1] for f in files}) == n, files


def test_the_rows_are_those_of_the_graph_in_memory(spark, stored):
    g = graph_queries.star_graph(spark, DIR)
    plain = g.match("n", "Nation").into("n", "LIVESIN", "c", "Customer").out("c", "PLACED", "o").table()
    walked = stored.chain("n", ("in", "LIVESIN", "c"), ("out", "PLACED", "o"), labels={"n": "Nation", "c": "Customer"}).table().select(*plain.columns)
    assert plain.exceptAll(walked).isEmpty() and walked.exceptAll(plain).isEmpty() and plain.count() > 0
    again = stored.match("n", "Nation").into("n", "LIVESIN", "c", "Customer").out("c", "PLACED", "o").table()
    assert again.exceptAll(plain).isEmpty() and again.count() == plain.count()
    assert stored.nodes.count() == g.nodes.count() and stored.edges.count() == g.edges.count()
    assert sorted(map(tuple, stored.label_counts().collect())) == sorted(map(tuple, g.label_counts().collect()))


def test_odd_nodes_and_edges(spark, tmp_path):
    nodes = spark.createDataFrame([("a", ["A", "B"], {"k": "v"}), ("b", ["B"], {}), ("c", [], None), ("d", None, {})], "id string, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([("a", "T", "b"), ("b", "T", "a"), ("a", "T", "a"), ("c", "U", "gone")], "src string, type string, dst string")
    name = f"g{uuid.uuid4().hex}"
    g = SG.save(Graph(nodes, edges), spark, name, str(tmp_path / "g"), buckets=2)
    assert sorted(r.id for r in g.label("A", "B").collect()) == ["a", "b"] and g.nodes.count() == 4
    plain = Graph(nodes, edges).match("x").out("x", "T", "y").out("y", "T", "z").table().select("x", "y", "z")
    walked = g.chain("x", ("out", "T", "y"), ("out", "T", "z")).table().select("x", "y", "z")
    assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, plain.collect())) and walked.count() == 4
    assert g.chain("x", ("out", "U", "y"), labels={"y": "A"}).table().count() == 0 and g.chain("x", ("out", "none", "y")).table().count() == 0
    assert sorted(map(tuple, SG.opened(spark, name).match("x", "A").out("x", "T", "y").table().orderBy(F.col("y")).collect())) == [("a", "a"), ("a", "b")]
    SG.dropped(spark, name, str(tmp_path / "g"))


def test_turns_are_counted_and_not_listed(spark, tmp_path):
    """As many as a chain of two hops lists, relationships that are there twice included."""
    edges = spark.createDataFrame([(a, "T", b) for a, b in ("an", "bn", "cn", "bn", "am", "nn")] + [("a", "U", "n")], "src string, type string, dst string")
    nodes = spark.createDataFrame([(x, ["A"], {}) for x in "abcnm"], "id string, labels array<string>, props map<string,string>")
    name = f"g{uuid.uuid4().hex}"
    g = SG.save(Graph(nodes, edges), spark, name, str(tmp_path / "g"), buckets=2)
    listed = g.chain("x", ("out", "T", "n"), ("in", "T", "y")).table().groupBy("n").count()
    found = g.turns("T", "n", "count")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, listed.collect())) == [("n", 18)]
    assert "Join" not in plan_of(found) and g.turns("V").isEmpty()
    SG.dropped(spark, name, str(tmp_path / "g"))


def test_a_graph_is_stored_as_far_as_it_is_asked_for(spark):
    """The folders written are those of the labels and types named, and the last hop of three stays where it is."""
    g = graph_queries.stored_star_graph(spark, DIR, ("Nation",), ("LIVESIN", "PLACED", "CONTAINS"))
    folders = lambda df, kind: {re.search(rf"{kind}=(\w+)", f)[1] for f in df.inputFiles()}
    assert folders(spark.table(f"{g.name}_nodes"), "label") == {"Nation"} and folders(spark.table(f"{g.name}_out"), "type") == {"LIVESIN", "PLACED", "CONTAINS"}
    whole = graph_queries.star_graph(spark, DIR)
    plain = whole.match("n", "Nation").into("n", "LIVESIN", "c").out("c", "PLACED", "o").out("o", "CONTAINS", "p").table()
    walked = g.chain("n", ("in", "LIVESIN", "c"), ("out", "PLACED", "o"), ("out", "CONTAINS", "p")).table().select(*plain.columns)
    assert plain.exceptAll(walked).isEmpty() and walked.exceptAll(plain).isEmpty()
    assert all("_out/" in f or "/out/" in f for f in walked.inputFiles() if "CONTAINS" in f)


def test_shared_variables_meet_on_both(spark):
    """Parts bought meet parts sold on part and nation: no row for a part and a supplier of another nation."""
    import re

    from trellis.plans import catalog

    plan = catalog.queries()["graph_shared_variables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(\(n#\d+ = n#\d+\) AND \(p#\d+ = p#\d+\)\)", plan)


def test_degrees_are_counted_without_joins(spark):
    """Edges are distinct already: neither their ends nor pairs are held a second time."""
    from trellis.plans import catalog

    rows = catalog.queries()["graph_two_level_grouping"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "distinct" not in plan and sum(r.n_orders for r in rows.collect()) > 0
