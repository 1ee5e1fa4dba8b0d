"""RDF, graph, tables, fact sheets, guard, files and streams on small hand-written inputs."""

import shutil
import json

import pytest
from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.operators import etl, guard, retrieval, shapes, ties
from trellis.operators import graph as G
from trellis.sources import files, rdf
from trellis.streaming import incremental

NS = "http://example.org/lab#"
DOC = f"""<?xml version="1.0"?>
<rdf:RDF xml:base="http://example.org/lab" xmlns:rdf="{rdf.RDF}" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:l="{NS}">
 <owl:Class rdf:about="{NS}Probe"/>
 <owl:NamedIndividual rdf:about="{NS}P_1"><rdf:type rdf:resource="{NS}Probe"/><rdf:type rdf:resource="{NS}Left"/>
  <l:rate>250Hz</l:rate><l:isOn rdf:resource="{NS}Boat_A"/><l:isOn rdf:resource="{NS}Boat_A"/><l:isOn rdf:resource="{NS}Nowhere"/></owl:NamedIndividual>
 <owl:NamedIndividual rdf:about="{NS}P_2"><rdf:type rdf:resource="{NS}Probe"/><l:rate>90Hz</l:rate><l:rate>100Hz</l:rate></owl:NamedIndividual>
 <owl:NamedIndividual rdf:about="{NS}Boat_A"><rdf:type rdf:resource="{NS}Boat"/><l:title>Élan</l:title></owl:NamedIndividual>
 <rdf:Description rdf:about="{NS}Odd"><l:title>x</l:title></rdf:Description>
</rdf:RDF>"""


@pytest.fixture(scope="module")
def lab(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rdf") / "lab.rdf"
    path.write_text(DOC, encoding="utf-8")
    return rdf.graph_of(rdf.read_triples(spark, str(path)), NS)


def test_rdf_becomes_a_graph(lab):
    nodes = {r.id: (r.labels, r.props) for r in lab.nodes.collect()}
    assert nodes["P_1"][0] == ["Left", "Probe"] and nodes["P_2"][1]["rate"] == "90Hz" and nodes["Boat_A"][1]["title"] == "Élan"
    assert nodes["Odd"][0] == ["Resource"] and "Probe" not in nodes
    assert [tuple(r) for r in lab.edges.collect()] == [("P_1", "ISON", "Boat_A")]


def test_conflicting_literals_are_reported(spark):
    rows = spark.createDataFrame([("a", "L", "k", "1"), ("a", "L", "k", "2"), ("b", "L", "k", "1")], "id string, label string, key string, value string")
    assert [(r.id, r["values"]) for r in G.conflicts(rows).collect()] == [("a", ["1", "2"])]


def test_tables_from_the_graph(lab):
    spec = etl.TableSpec("probes", ("Probe",), "probe_id", {"rate": "rate"}, (etl.Link("boat_id", "ISON"),), "kind", {"rate_hz": X.strip_unit(F.col("rate"), "Hz")})
    rows = {r.probe_id: r for r in etl.project_table(lab, spec).collect()}
    assert rows["P_1"].rate_hz == 250 and rows["P_1"].boat_id == "Boat_A" and rows["P_2"].boat_id is None and rows["P_2"].kind == "Probe"
    required = etl.TableSpec("probes", ("Probe",), "probe_id", links=(etl.Link("boat_id", "ISON", required=True),))
    assert [r.probe_id for r in etl.project_table(lab, required).collect()] == ["P_1"]
    assert etl.project_relation(lab, "ISON", "probe_id", "boat_id", ("Probe",), ("Boat",)).count() == 1


def test_fact_sheets_prose_and_trace(spark):
    base = spark.createDataFrame([("Boat_A",), ("Boat_B",)], "boat string")
    probes = spark.createDataFrame([("Boat_A", "P_2", "90Hz"), ("Boat_A", "P_1", "250Hz")], "boat string, probe string, rate string")
    sheets = etl.nest(base, "boat", probes=probes)
    assert {r.boat: [p.probe for p in r.probes] for r in sheets.collect()} == {"Boat_A": ["P_1", "P_2"], "Boat_B": []}
    prose = etl.render(F.concat(F.lit("The boat "), "boat", F.lit(".")), ("Probes:", "probes", lambda p: F.concat(p["probe"], F.lit(" at "), p["rate"], F.lit("."))))
    docs = sheets.select("boat", prose.alias("text"))
    assert {r.boat: r.text for r in docs.collect()} == {"Boat_A": "The boat Boat_A.\n\nProbes: P_1 at 250Hz. P_2 at 90Hz.", "Boat_B": "The boat Boat_B."}
    facts = sheets.select("boat", F.flatten(F.array(F.array("boat"), F.col("probes.probe"), F.col("probes.rate"))).alias("facts"))
    assert {r.verdict for r in etl.trace(docs, facts, "boat").collect()} == {"PASS"}
    wrong = docs.withColumn("text", F.concat("text", F.lit(" Also 77Hz.")))
    assert {tuple(r.invented) for r in etl.trace(wrong, facts, "boat").collect()} == {("77Hz",)}


def test_spot_check_is_seeded(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 50, "a").otherwise("b"))
    one, two = (sorted(r.id for r in etl.spot_check(df, "id", "g", {"a": 7, "b": 3}, 5).collect()) for _ in range(2))
    assert one == two and len(one) == 10


def test_role_rollup(spark):
    rows = spark.createDataFrame([("p1", "r", "a"), ("p1", "r", "b"), ("p2", "r", "b")], "phase string, role string, who string")
    assert {(r.phase, tuple(r.only_here)) for r in etl.role_phase_rollup(rows, "phase", "role", "who").collect()} == {("p1", ("a",)), ("p2", ())}


def test_optional_and_anti_patterns(spark):
    nodes = spark.createDataFrame([("a", ["A"], {}), ("b", ["A"], {}), ("x", ["B"], {}), ("y", ["B"], {})], "id string, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([("a", "T", "x"), ("a", "T", "y")], "src string, type string, dst string")
    g = G.Graph(nodes, edges)
    hop = g.match("u", "A").out("u", "T", "v", "B", where=F.col("id") == "x")
    assert sorted((r.u, r.v) for r in g.match("u", "A").optional(hop).table().collect()) == [("a", "x"), ("b", None)]
    assert [r.u for r in g.match("u", "A").without(hop).table().collect()] == ["b"]
    assert g.match("u", "A").out("u", "T", "v").out("u", "T", "w").table().count() == 2  # relationships differ


GUARD = [
    ("SELECT a FROM t JOIN u USING (k)", True), ("SELECT 'it was updated; and dropped' AS x", True), ("SELECT * FROM t WHERE x LIKE '%DROP%'", True), ("select 1", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True),
    ("DROP TABLE t", False), ("SELECT 1; DELETE FROM t", False), ("DELETE FROM t", False), ("-- SELECT\nDROP TABLE t", False), ("", False), ("INSERT INTO t SELECT 1", False), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", False),
]


@pytest.mark.parametrize("sql,ok", GUARD)
def test_guard(spark, sql, ok):
    session = spark.newSession()
    session.sql("SELECT 1 AS a, 2 AS k, 'x' AS x").createOrReplaceTempView("t")
    session.sql("SELECT 2 AS k").createOrReplaceTempView("u")
    assert guard.check_statement(session, sql)[0] == ok


def test_controller_feeds_back(spark):
    said = []

    def generate(question, feedback):
        said.append(feedback)
        return ["DROP TABLE t", "SELECT 1 AS x LIMIT 1", "SELECT 1 AS x"][len(said) - 1]

    df, sql, attempts, reason = guard.answer(spark, "which is the most?", generate)
    assert df.first().x == 1 and attempts == 3 and reason == "" and "SELECT" in said[1] and "ties" in said[2]
    assert guard.answer(spark, "q", lambda q, f: "DROP TABLE t", 2)[0] is None
    assert not guard.needs_aggregate("how many are there?", "SELECT x FROM t")[0]


def test_text_functions(spark):
    df = spark.createDataFrame([("45min", "250Hz", "a b/é!", "<p>Hi <b>you</b></p>", "```sql\nSELECT 1\n```", "Event_1 and event_10", '{"ok": true}')], "a string, b string, c string, d string, e string, f string, g string")
    r = df.select(
        X.leading_int(F.col("a")).alias("a"), X.strip_unit(F.col("b"), "Hz").alias("b"), X.strip_unit(F.col("a"), "Hz").alias("b2"), X.slug(F.col("c")).alias("c"), X.strip_html(F.col("d")).alias("d"),
        X.unfence(F.col("e")).alias("e"), X.whole_word(F.col("f"), F.lit("EVENT_1")).alias("f"), X.whole_word(F.col("f"), F.lit("Event")).alias("f2"), X.strict_boolean(F.col("g"), "ok").alias("g"), X.strict_boolean(F.lit('{"ok": "true"}'), "ok").alias("g2"),
    ).first()
    assert (r.a, r.b, r.b2, r.c, r.d, r.e, r.f, r.f2, r.g, r.g2) == (45, 250, None, "a_b", "Hi you", "SELECT 1", True, False, True, None)


def test_diff_ties_and_fallback(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, f string, g int")
    b = spark.createDataFrame([(2, "y", 2), (3, "z", 1), (4, "w", 1)], "k int, f string, g int")
    assert sorted((r.k, r.kind, r.field, r.left_value, r.right_value) for r in shapes.keyed_diff(a, b, ["k"], ["f", "g"]).collect()) == [(1, "missing_right", None, None, None), (2, "mismatch", "g", "1", "2"), (4, "missing_left", None, None, None)]
    assert sorted(r.k for r in ties.argmax_all(a, "g").collect()) == [2, 3] and ties.argmax_all(a.where("k = 1"), "g").count() == 0
    assert shapes.with_fallback(a.where("k > 9"), a.where("k = 1"), a).count() == 1


def test_merge_counts_forced_documents_against_k(spark):
    pools = spark.createDataFrame([(1, "f1", 0, 1), (1, "f2", 0, 2), (1, "p1", 1, 1), (1, "f1", 2, 1), (1, "g1", 2, 2)], "question_id int, doc_id string, pool int, position int")
    order = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert order(retrieval.merge(pools, 10)) == ["f1", "f2", "p1", "g1"] and order(retrieval.merge(pools, 1)) == ["f1"]
    assert order(retrieval.merge(pools, 10, F.col("doc_id") == "g1")) == ["f1", "f2", "g1", "p1"]
    assert order(retrieval.merge(pools, 10, F.col("doc_id") == "f1")) == ["f1", "f2", "p1", "g1"]


def test_files(spark, tmp_path):
    (tmp_path / "c/boats").mkdir(parents=True)
    (tmp_path / "c/boats/A_1.txt").write_text("text é")
    (tmp_path / "c/boats/B.txt").write_text("  \n")
    assert [tuple(r) for r in files.read_corpus(spark, str(tmp_path / "c")).collect()] == [("A_1", "text é", "boat", "A_1.txt")]
    questions = {"test_questions": [{"question_id": f"Q{i}", "question": "?", "ground_truth": "", "category": "c", "difficulty": "easy"} for i in range(1, 13)]}
    (tmp_path / "q.json").write_text(json.dumps(questions))
    ids = lambda **k: [r.question_id for r in files.read_questions(spark, str(tmp_path / "q.json"), **k).orderBy("ordinal").collect()]
    assert ids(only=["Q3"], limit=1, start="Q9") == ["Q3"] and ids(start="Q9") == ["Q9", "Q10", "Q11", "Q12"] and ids(start="Q9", limit=2) == ["Q9", "Q10"]
    for wrong in ({"only": ["Q99"]}, {"limit": -1}):
        with pytest.raises(ValueError):
            ids(**wrong)
    assert files.describe_schema(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, n int")) == {"s": ("string", ["a", "b"]), "n": ("int", [])}


def test_conversations_keep_their_creation_time(spark):
    schema = files.CONVERSATION
    old = spark.createDataFrame([("1", "t", [], "2020", "2021"), ("2", "u", [], "2020", None)], schema)
    new = spark.createDataFrame([("1", "t2", [], "2029", "2030"), ("3", "v", [], "2030", "2030")], schema)
    got = {r.id: (r.title, r.created_at) for r in files.save_conversation(old, new).collect()}
    assert got == {"1": ("t2", "2020"), "2": ("u", "2020"), "3": ("v", "2030")}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:10", 5), (2, "2024-01-01 00:00:20", 1), (1, "2024-01-01 00:02:00", 7)], "k int, at string, v int").selectExpr("k", "cast(at as timestamp) ts", "v").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("k int, ts timestamp, v int").parquet(source)
    q = incremental.upsert_into(spark, stream(), str(tmp_path / "table"), "k", "ts", str(tmp_path / "cp1"))
    q.awaitTermination(60)
    kept = lambda: {(r.k, r.v) for r in incremental.read_upserted(spark, str(tmp_path / "table"), "k int, ts timestamp, v int").collect()}
    assert kept() == {(1, 7), (2, 1)}
    for n in range(3):  # later batches touch one bucket; old versions go
        spark.createDataFrame([(2, f"2024-01-02 00:00:0{n}", 20 + n)], "k int, at string, v int").selectExpr("k", "cast(at as timestamp) ts", "v").write.mode("append").parquet(source)
        incremental.upsert_into(spark, stream(), str(tmp_path / "table"), "k", "ts", str(tmp_path / "cp1")).awaitTermination(60)
    assert kept() == {(1, 7), (2, 22)}
    assert sorted(map(len, incremental._versions(spark, str(tmp_path / "table")).values())) == [1, 2]
    shutil.rmtree(source)
    spark.createDataFrame([(1, "2024-01-01 00:00:10", 5), (2, "2024-01-01 00:00:20", 1), (1, "2024-01-01 00:02:00", 7)], "k int, at string, v int").selectExpr("k", "cast(at as timestamp) ts", "v").coalesce(1).write.parquet(source)
    q = incremental.append_results(incremental.tumbling(stream(), "ts", "1 minute", "0 seconds", ["k"], "v"), str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert {(r.k, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1, 5), (2, 1, 1)}
    q = incremental.append_results(incremental.first_seen(stream(), "ts", "1 hour", F.col("k")), str(tmp_path / "seen"), str(tmp_path / "cp3"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 2
