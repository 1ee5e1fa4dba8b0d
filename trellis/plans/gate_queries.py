"""Named queries: guards and gates of questions and statements, functions of answers and judgements, controllers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis import plugins
from trellis.functions import answers as A
from trellis.functions import questions as Q
from trellis.functions import text as X
from trellis.operators import calls
from trellis.operators import etl
from trellis.operators import evaluation as E
from trellis.operators import fusion as U
from trellis.operators import guard
from trellis.operators import integrity
from trellis.operators import retrieval as R
from trellis.operators import ties as T
from trellis.plans.catalog import register
from trellis.session import table as t


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(column: str, cues: list[str]) -> str:
    return f"list_bool_or(list_transform({_sql_list(cues)}, lambda c: contains({column}, c)))"


def _picked(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


# ---- questions ------------------------------------------------------------------------------

QUESTIONS = [
    "Combien d’événements sportifs sont enregistrés ?", "Quelle est la race de cheval la plus courante ?", "Le cheval Alto a-t-il plus de séances que Brio ?",
    "Compare la compétition de Saumur par rapport à celle de Nantes", "Les fréquences sont-elles cohérentes ?", "Quels chevaux engagés mais sans résultat officiel ?",
    "Quel capteur au garrot ?", "Où a lieu le Dressage Amateur 2 ?", "Les capteurs IMU sortent du schéma ?", "Quelle heure est-il ?", "", "Comment varie l'intensité Élevée, ÉLEVÉE ou pic ?",
    "Durée des séances en PreCompetitionStage ?", "Quel cheval a le plus de capteurs ?",
]
_Q = f"SELECT p_partkey AS id, {_sql_list(QUESTIONS)}[p_partkey % {len(QUESTIONS)} + 1] AS question FROM part"
_NORMAL = "replace(replace(lower(question), '’', ''''), '`', '''')"


def _asked(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), _picked(QUESTIONS, "p_partkey").alias("question"))


@register(
    "intent_gates",
    f"""WITH n AS (SELECT id, {_NORMAL} AS q FROM ({_Q}))
    SELECT id, {_any('q', Q.COMPARATIVE)} OR regexp_matches(q, '\\b(plus|moins)\\b.{{0,40}}\\bque\\b') AS comparative, {_any('q', Q.VERIFICATION)} AS verification, {_any('q', Q.AGGREGATION)} AS aggregation,
    CASE WHEN {_any('q', Q.EVENT_FIRST)} THEN 'event' WHEN {_any('q', Q.HORSE_FIRST)} THEN 'horse' WHEN {_any('q', Q.HORSE)} AND NOT {_any('q', Q.EVENT)} THEN 'horse'
      WHEN {_any('q', Q.EVENT)} AND NOT {_any('q', Q.HORSE)} THEN 'event' END AS preferred,
    CASE WHEN {_any('q', Q.VERIFICATION)} THEN 5 ELSE 15 END AS k FROM n""",
)
def intent_gates(spark, d):
    q = F.col("question")
    verification = Q.is_verification(q)
    return _asked(spark, d).select("id", Q.is_comparative(q).alias("comparative"), verification.alias("verification"), Q.is_aggregation(q).alias("aggregation"), Q.preferred_type(q).alias("preferred"), R.effective_k(verification).alias("k"))


@register(
    "taxonomy_values",
    f"""SELECT id, array_to_string(list_filter({_sql_list(sorted(Q.TAXONOMY, key=len, reverse=True))}, lambda v: contains(lower(question), lower(v))), '|') AS named FROM ({_Q})""",
)
def taxonomy_values(spark, d):
    return _asked(spark, d).select("id", F.array_join(Q.taxonomy_values(F.col("question")), "|").alias("named"))


STATEMENTS = [
    "SELECT horse_id FROM sensors GROUP BY horse_id", "SELECT count(*) FROM events", "SELECT name FROM horses ORDER BY name LIMIT 1", "SELECT horse_id, COUNT(*) AS n FROM sensors GROUP BY horse_id ORDER BY n DESC\nLIMIT 1", "",
]


@register(
    "statement_gates",
    f"""WITH n AS (SELECT id, lower(question) AS q, lower(replace({_sql_list(STATEMENTS)}[id // {len(QUESTIONS)} % {len(STATEMENTS)} + 1], chr(10), ' ')) AS s FROM ({_Q})),
    f AS (SELECT *, {_any('q', Q.COUNTING)} AS asks, {_any('s', Q.AGGREGATES)} AS has, {_any('s', Q.AGGREGATES[:-1])} AS counts, {_any('q', Q.DISTRIBUTION)} AS spread FROM n)
    SELECT id, CASE WHEN asks AND has AND NOT counts AND spread THEN 'bare group' WHEN asks AND NOT has THEN 'no aggregate' ELSE 'ok' END AS aggregate,
      CASE WHEN NOT contains(s, 'limit 1') THEN 'ok' WHEN contains(q, 'capteur') AND {_any('q', ['moins', 'plus'])} AND contains(s, 'sensor') THEN 'histogram' WHEN {_any('q', Q.SUPERLATIVES)} THEN 'ties' ELSE 'ok' END AS ties FROM f""",
)
def statement_gates(spark, d):
    s = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.floor(F.col("id") / len(QUESTIONS)) % len(STATEMENTS) + 1).cast("int"))
    rows = _asked(spark, d).withColumn("s", s)
    why, ties = Q.aggregate_complaint(F.col("question"), F.col("s")), Q.tie_complaint(F.col("question"), F.col("s"))
    return rows.select(
        "id", F.when(why.isNull(), "ok").when(why.contains("beside"), "bare group").otherwise("no aggregate").alias("aggregate"),
        F.when(ties.isNull(), "ok").when(ties.contains("histogram"), "histogram").otherwise("ties").alias("ties"),
    )


#: Statements of a pattern language, with a part's name as an identifier or a literal, and the guard's verdict.
PATTERNS = [
    ("MATCH (h:Horse) WHERE h.name = '{n}' RETURN h.id", "ok"), ("```cypher\nMATCH (h) RETURN h AS `{n}`\n```", "ok"), ("", "empty"), ("MATCH (n) RETURN n; MATCH (m) RETURN m.`{n}`", "more than one statement"),
    ("MATCH (n:`{n}`) DETACH DELETE n", "forbidden: DELETE"), ("MATCH (n) SET n.x = '{n}' RETURN n", "forbidden: SET"), ("MATCH (n) RETURN n.type, count(*) GROUP BY n.`{n}`", "unsupported: GROUP BY"),
    ("MATCH (n:`{n}`)", "nothing is returned"), ("MATCH (n) RETURN n.settled AS `{n}`;", "ok"), ("load csv from '{n}' as r return r", "forbidden: LOAD CSV"),
]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cases(key: str, rows: list[tuple]) -> str:
    """SQL: the verdict of the statement that a row's key picks."""
    return f"CASE {key} % {len(rows)} " + " ".join(f"WHEN {i} THEN {_text(r[1])}" for i, r in enumerate(rows)) + " END"


def _statement(key: Column, name: Column, rows: list[tuple]) -> Column:
    """The statement that a row's key picks, with the name put in."""
    return F.replace(F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (key % len(rows) + 1).cast("int")), F.lit("{n}"), name)


@register("pattern_guard", f"SELECT p_partkey, {_cases('p_partkey', PATTERNS)} AS verdict FROM part")
def pattern_guard(spark, d):
    """A statement for each part, judged as a column."""
    statement = _statement(F.col("p_partkey"), F.col("p_name"), PATTERNS)
    return t(spark, d, "part").select("p_partkey", F.coalesce(Q.pattern_complaint(statement), F.lit("ok")).alias("verdict"))


#: The same for SQL: what the analysed plan shows decides.
GUARDED = [
    ("SELECT count(*) AS `drop {n}` FROM part WHERE p_type = '{n}'", "ok"), ("SELECT max(p_size), '{n}; DROP TABLE part --' AS x FROM part /* {n} */ GROUP BY p_brand", "ok"), ("DROP TABLE `{n}`", "must start with SELECT"),
    ("SELECT p_size FROM part; DELETE FROM part WHERE p_type = '{n}'", "not one valid statement"), ("SELECT java_method('java.lang.Math', 'abs', 1) AS `{n}` FROM part", "must not be called"),
    ("SELECT (SELECT max(`reflect`('java.lang.Math', 'abs', p_size)) FROM part) AS `{n}`", "must not be called"), ("SELECT `{n}` FROM part", "not one valid statement"), ("SELECT n_name AS `{n}` FROM nation", "must not be read"),
    ("SELECT '{n}' AS x FROM part WHERE p_partkey IN (SELECT n_nationkey FROM nation)", "must not be read"), ("WITH nation AS (SELECT p_size AS a FROM part) SELECT count(a) AS `max(` FROM nation", "ok"),
    ("SELECT p_size AS upper, 'sum({n})' AS sha1 FROM part AS nation (a, b, c, d, p_size, f)", "ok"), ("SELECT transform(array(p_size), x -> upper('{n}')) FROM part", "must not be called"), ("WITH x AS (SELECT '{n}' AS a) INSERT INTO part SELECT * FROM x", "not a part of a query"),
    ("SELECT count(*) FROM range(3) WHERE '{n}' > ''", "ok"), ("SELECT count(p_size) FROM (SELECT p_size FROM part UNION ALL SELECT length('{n}') FROM part)", "must not be called"),
]


@register("statement_guard", f"WITH s AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT p_brand, p_type, {_cases('k', GUARDED)} AS verdict FROM s")
def statement_guard(spark, d):
    """A statement for each brand and type of part, with lists of the functions and views that it may use. The views are
    those of a session of their own, so no caller's view is replaced."""
    session = spark.newSession()
    for name in ("part", "nation"):
        t(session, d, name).createOrReplaceTempView(name)
    kinds = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k")).select("p_brand", "p_type", _statement(F.col("k"), F.col("p_type"), GUARDED).alias("statement"))
    rows = []
    for r in kinds.toLocalIterator():  # statements are analysed where Spark plans them, one by one
        ok, reason = guard.check_statement(session, r["statement"], functions={"count", "max", "transform", "array"}, tables={"part"})
        verdicts = {v for _, v in GUARDED if v in reason}
        rows.append((r["p_brand"], r["p_type"], "ok" if ok else verdicts.pop() if verdicts else reason))
    return spark.createDataFrame(rows, "p_brand string, p_type string, verdict string")


@register("function_gate", "SELECT p_brand, max(p_size) % 2 = 0 AS accepted FROM part GROUP BY p_brand")
def function_gate(spark, d):
    """With a list of functions any other is refused: a brand's largest size says whether its statement calls one."""
    session = spark.newSession()
    t(session, d, "part").createOrReplaceTempView("part")
    brands = t(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("size")).toLocalIterator()
    call = lambda r: "max" if r["size"] % 2 == 0 else "length"
    rows = [(r["p_brand"], guard.check_statement(session, f"SELECT {call(r)}(p_name) AS `count(` FROM part WHERE (p_size > 1) AND p_brand = '{r['p_brand']}' GROUP BY p_name", functions={"count", "max"})[0]) for r in brands]
    return spark.createDataFrame(rows, "p_brand string, accepted boolean")


def _events_session(spark, d):
    """A session of its own with the view ``events``: no caller's view is replaced."""
    session = spark.newSession()
    t(session, d, "events").createOrReplaceTempView("events")
    return session, [r[0] for r in t(spark, d, "events").select("event_type").distinct().collect()]


@register("retry_controller", "SELECT event_type, count(*) AS n, CAST(CASE WHEN event_type < 'm' THEN 3 ELSE 2 END AS INTEGER) AS attempts, true AS timed FROM events GROUP BY event_type")
def retry_controller(spark, d):
    """For each type of event a generator is asked until its statement passes the gates and can be analysed: a
    command or a list for a count, a column that is not there, then a count. What the last one finds is returned."""
    session, kinds = _events_session(spark, d)
    rows = []
    for kind in kinds:
        drafts = iter((["DROP TABLE events"] if kind < "m" else []) + ["SELECT event_id FROM events" if len(kind) % 2 else "SELECT count(nothing) FROM events", f"SELECT count(*) AS n FROM events WHERE event_type = '{kind}'"])
        generate = plugins.Timed(lambda question, feedback, drafts=drafts: next(drafts))
        found, _, made, _ = guard.answer(session, f"How many events of {kind} are there?", generate)
        rows.append((kind, found.first()["n"], made, len(generate.seconds) == made and min(generate.seconds) >= 0))
    return spark.createDataFrame(rows, "event_type string, n long, attempts int, timed boolean")


@register("one_shot_correction", "SELECT event_type, CASE WHEN event_type < 'm' THEN max(event_id) END AS last, CAST(2 AS INTEGER) AS attempts, true AS heard FROM events GROUP BY event_type")
def one_shot_correction(spark, d):
    """One more attempt with the complaint of the parser or analyser as feedback, and none after that: some types
    of events are mended by it, the others given up."""
    session, kinds = _events_session(spark, d)
    rows = []
    for kind in kinds:
        heard = []

        def generate(question, feedback, kind=kind, heard=heard):
            heard.append(feedback)
            if not feedback:
                return "SELEC max(event_id) FROM events" if len(kind) % 2 else "SELECT max(nothing) AS last FROM events"
            return f"SELECT max(event_id) AS last FROM events WHERE event_type = '{kind}'" if kind < "m" else "SELECT FROM WHERE"

        found, _, made, _ = guard.answer(session, f"Which event of {kind} came last?", generate, attempts=2)
        rows.append((kind, found.first()["last"] if found is not None else None, made, ("must start with SELECT" if len(kind) % 2 else "nothing") in heard[1]))
    return spark.createDataFrame(rows, "event_type string, last long, attempts int, heard boolean")


@register("list_comprehension", "SELECT n_name AS nation, array_to_string(list_transform(list_filter(list_sort(list(s_suppkey)), lambda k: k % 2 = 0), lambda k: 'S' || k), ',') AS even FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def list_comprehension(spark, d):
    """[k IN list WHERE k is even | 'S' + k]"""
    rows = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("ids"))
    return rows.select("nation", F.array_join(F.transform(F.filter("ids", lambda k: k % 2 == 0), lambda k: F.concat(F.lit("S"), k.cast("string"))), ",").alias("even"))


def _counted(doc_id, text):
    """A plug-in that counts words, fails on texts without any, and hangs on some documents."""
    import re
    import time

    if doc_id % 300 == 7:
        time.sleep(600)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        raise ValueError("no words")
    return len(words)


@register(
    "timeout_wrapper",
    """SELECT doc_id, CASE WHEN doc_id % 300 = 7 THEN NULL ELSE nullif(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 0) END AS value,
    CASE WHEN doc_id % 300 = 7 THEN 'timeout' WHEN len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) = 0 THEN 'ValueError' END AS reason, true AS timed FROM documents""",
)
def timeout_wrapper(spark, d):
    """A plug-in called for each document in its task, within two seconds, sixteen of them at once while they hang: values, reasons and times are columns."""
    rows = calls.with_calls(t(spark, d, "documents").select("doc_id", "text"), _counted, ["doc_id", "text"], 2.0, "long", together=16)
    return rows.select("doc_id", "value", F.regexp_extract("reason", r"^(\w+)", 1).alias("reason"), (F.col("seconds") >= 0).alias("timed"))


# ---- scalar functions -----------------------------------------------------------------------


@register("leading_real", "SELECT p_partkey, CAST(nullif(regexp_extract(x, '^\\s*(-?\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) AS v FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice || ' EUR' WHEN 1 THEN ' -' || p_size || 'x' WHEN 2 THEN 'none' END AS x FROM part)")
def leading_real(spark, d):
    x = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_retailprice || ' EUR' WHEN 1 THEN ' -' || p_size || 'x' WHEN 2 THEN 'none' END")
    return t(spark, d, "part").select("p_partkey", X.leading_real(x).alias("v"))


@register("strip_unit", "SELECT p_partkey, TRY_CAST(replace(x, 'Hz', '') AS INTEGER) AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || 'min' ELSE p_size || 'Hz' END AS x FROM part)")
def strip_unit(spark, d):
    x = F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_size || 'min' ELSE p_size || 'Hz' END")
    return t(spark, d, "part").select("p_partkey", X.strip_unit(x, "Hz").alias("v"))


@register("type_report", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(field, type)")
def type_report(spark, d):
    return integrity.type_report(t(spark, d, "nation"))


@register("composite_keys", "SELECT l_returnflag || '|' || l_linestatus || '|' || coalesce(CAST(nullif(l_linenumber, 3) AS VARCHAR), '') AS key, count(*) AS n FROM lineitem GROUP BY 1")
def composite_keys(spark, d):
    return t(spark, d, "lineitem").groupBy(X.composite_key(F.col("l_returnflag"), F.col("l_linestatus"), F.nullif(F.col("l_linenumber"), F.lit(3))).alias("key")).agg(F.count("*").alias("n"))


@register("iso_days", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def iso_days(spark, d):
    return t(spark, d, "orders").groupBy(X.iso_day(F.col("o_orderdate")).alias("day")).agg(F.count("*").alias("n"))


@register("picked_labels", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Sternum' WHEN 1 THEN 'Withers' END AS other, CASE WHEN s_suppkey % 3 = 1 THEN 'Withers' END AS allowed FROM supplier")
def picked_labels(spark, d):
    """The first label that is not the generic one, the first of an allowed set, or null."""
    labels = F.expr("CASE s_suppkey % 3 WHEN 0 THEN array('Sensor', 'Sternum', 'Withers') WHEN 1 THEN array('Withers') ELSE array('Sensor') END")
    return t(spark, d, "supplier").select("s_suppkey", X.first_other(labels, "Sensor").alias("other"), X.first_of(F.filter(labels, lambda x: F.col("s_suppkey") % 3 == 1), ["Withers", "Sternum"]).alias("allowed"))


@register("unfenced", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN s_name ELSE 'SELECT ' || s_suppkey END AS inside FROM supplier")
def unfenced(spark, d):
    x = F.expr(r"CASE s_suppkey % 3 WHEN 0 THEN 'Here:\n```sql\nSELECT ' || s_suppkey || '\n```\nDone' WHEN 1 THEN '```\nSELECT ' || s_suppkey || '```' ELSE '  ' || s_name || '\n' END")
    return t(spark, d, "supplier").select("s_suppkey", X.unfence(x).alias("inside"))


@register("canonical_rows", """SELECT s_suppkey, '{"k":' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ',"name":"' || s_name || '"' END || ',"nation":' || s_nationkey || '}' AS row FROM supplier""")
def canonical_rows(spark, d):
    """A row as JSON with its fields in order of name; nulls are left out."""
    rows = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_name")).alias("name"), F.col("s_suppkey").alias("k"))
    return rows.select(F.col("k").alias("s_suppkey"), E.canonical_json(rows).alias("row"))


@register(
    "canonical_nested",
    """WITH m AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id, '{"a":[{"p":' || user_id || ',"q":"' || event_type || '"},{"q":"' || event_type || '"}],"m":{"' || least(event_type, 'm') || '":' || CASE WHEN event_type <= 'm' THEN '{"y":' || k || '}' ELSE '{"x":' || k || '}' END
      || CASE WHEN event_type = 'm' THEN '' ELSE ',"' || greatest(event_type, 'm') || '":' || CASE WHEN event_type > 'm' THEN '{"y":' || k || '}' ELSE '{"x":' || k || '}' END END || '}'
      || CASE WHEN user_id % 2 = 0 THEN ',"z":{"b":{"c":' || event_id || '}}' ELSE '' END || '}' AS row FROM m""",
)
def canonical_nested(spark, d):
    """Structs in lists, structs in maps and structs in structs: every level in order of name or key."""
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    kind, none = F.col("event_type"), F.lit(None).cast("long")
    pair = lambda q, p: F.struct(q.alias("q"), p.alias("p"))
    value = lambda y, x: F.struct(y.alias("y"), x.alias("x"))
    no = F.lit(None).cast("int")
    rows = t(spark, d, "events").select(
        F.when(F.col("user_id") % 2 == 0, F.struct(F.lit(None).cast("string").alias("d"), F.struct(F.col("event_id").alias("c")).alias("b"))).alias("z"),
        F.map_from_arrays(F.array(kind, F.lit("m")), F.array(value(k, no), value(no, k))).alias("m"), F.array(pair(kind, F.col("user_id")), pair(kind, none)).alias("a"), F.col("event_id"),
    )
    return rows.select("event_id", E.canonical_json(rows.drop("event_id")).alias("row"))


#: A judge's replies, with the numbers of an event in place of {v} (its value in hundredths, as a share) and {w}.
REPLIES = [
    ('{"groundedness": {v}, "completeness": 1, "relevance": 0}', "ok"), ('```json\n{"groundedness": {v}, "completeness": "0.25", "relevance": 1.0, "reasoning": {"groundedness": "}"}}\n```', "ok"), ('Sure: {"groundedness": {v}, "completeness": 1, "relevance": 1} done', "ok"),
    ('{"groundedness": {v}, "completeness": 1}', "relevance is missing"), ('{"groundedness": 1{w}, "completeness": 1, "relevance": 0}', "groundedness is out of range"), ('{"groundedness": "high {v}", "completeness": 1, "relevance": 0}', "groundedness is no number"),
    ("no idea {v}", "no object"), ("{groundedness {v}}", "no JSON"), ('{"groundedness": {v}, "completeness": null, "relevance": 0}', "completeness is missing"), ('{"groundedness": true, "completeness": 1, "relevance": 0}', "groundedness is no number"),
    ('{"groundedness": {v}, "completeness": [1], "relevance": 0}', "completeness is no number"),
]
_SHARE = "least(abs(CAST(floor(value) AS BIGINT)) % 100, 99)"


@register("judge_scores", f"SELECT event_id, {_cases('event_id', REPLIES)} AS verdict, CASE WHEN {_cases('event_id', REPLIES)} = 'ok' THEN round({_SHARE} / 100.0, 2) END AS groundedness FROM events WHERE value IS NOT NULL")
def judge_scores(spark, d):
    """A judge's reply about each event, with the event's number in it, read strictly."""
    rows = t(spark, d, "events").where("value IS NOT NULL").withColumn("v", F.expr(f"{_SHARE}"))
    reply = F.element_at(F.array(*[F.lit(r) for r, _ in REPLIES]), (F.col("event_id") % len(REPLIES) + 1).cast("int"))
    reply = F.replace(F.replace(reply, F.lit("{v}"), F.concat(F.lit("0."), F.lpad(F.col("v").cast("string"), 2, "0"))), F.lit("{w}"), F.lpad(F.col("v").cast("string"), 2, "0"))
    return rows.select("event_id", A.judge_scores(reply).alias("s")).select("event_id", F.coalesce("s.error", F.lit("ok")).alias("verdict"), F.round("s.groundedness", 2).alias("groundedness"))


@register(
    "honest_answers",
    f"""WITH a AS (SELECT s_suppkey, [NULL, '', 'Aucun cheval', 'Le document ne contient pas ce nom', 'Alto', 'Cette information n''est pas disponible', 'pas de données'][s_suppkey % 7 + 1] AS x FROM supplier)
    SELECT s_suppkey, coalesce({_any('lower(x)', A.UNAVAILABLE)}, false) AS unavailable, coalesce({_any('lower(x)', A.NO_INFORMATION)}, false) AS no_information FROM a""",
)
def honest_answers(spark, d):
    """A missing or blank answer is not one that honestly says there is none."""
    values = [None, "", "Aucun cheval", "Le document ne contient pas ce nom", "Alto", "Cette information n'est pas disponible", "pas de données"]
    x = F.element_at(F.array(*map(F.lit, values)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return t(spark, d, "supplier").select("s_suppkey", A.is_unavailable(x).alias("unavailable"), A.is_no_information(x).alias("no_information"))


@register(
    "truncated_passages",
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS x, list_sum(list_transform(string_split(text, chr(10)), lambda s: length(s))) AS n FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, x, n, CASE WHEN n <= 300 THEN x ELSE list_transform(x, lambda s: CASE WHEN length(s) > greatest(1, floor(length(s) * 300 / n)) THEN substring(s, 1, CAST(greatest(1, floor(length(s) * 300 / n)) AS INTEGER)) || '…[truncated]' ELSE s END) END AS y FROM p)
    SELECT doc_id, CAST(least(list_sum(list_transform(y, lambda s: length(s))), greatest(300, len(list_filter(y, lambda s: length(s) > 0)))) AS BIGINT) AS chars, y[1][1:1] AS start FROM c""",
)
def truncated_passages(spark, d):
    """Cut in proportion, marked, and trimmed from the longest: the sum is the limit, unless single characters exceed it."""
    cut = t(spark, d, "documents").where("text is not null").select("doc_id", A.truncate_passages(F.split("text", "\n"), 300).alias("x"))
    return cut.select("doc_id", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + F.length(v)).alias("chars"), F.substring(F.get("x", F.lit(0)), 1, 1).alias("start"))


@register("embedding_cost", "SELECT lang, round(sum(length(text) / 4.0 * 0.00002), 6) AS cost FROM documents GROUP BY lang")
def embedding_cost(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(A.embedding_cost(F.col("text"))), 6).alias("cost"))


# ---- evaluation and reports -----------------------------------------------------------------


@register("mean_or_zero", "SELECT o_orderstatus AS status, round(coalesce(avg(CASE WHEN o_totalprice > 400000 AND o_orderstatus <> 'P' THEN o_totalprice END), 0.0), 4) AS mean FROM orders GROUP BY 1")
def mean_or_zero(spark, d):
    """The mean of nothing is 0.0 in reports that say so."""
    value = F.when((F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") != "P"), F.col("o_totalprice"))
    return t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(E.mean_or_zero(value), 4).alias("mean"))


@register("worst_with_nan", "SELECT p_partkey FROM part ORDER BY CASE WHEN p_partkey % 10 = 0 THEN -1 ELSE p_retailprice END, p_partkey LIMIT 5")
def worst_with_nan(spark, d):
    """Rows without a score (NaN) are the worst, not the best."""
    scored = t(spark, d, "part").withColumn("score", F.when(F.col("p_partkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")))
    return scored.orderBy(T.nan_last(F.col("score")), "p_partkey").limit(5).select("p_partkey")


@register(
    "fusion_report",
    """WITH q AS (SELECT o_orderkey AS id, o_orderkey % 5 AS m, CAST(o_orderkey % 7 AS DOUBLE) / 7 AS x FROM orders)
    SELECT count(*) AS questions, count(*) FILTER (WHERE m = 0) AS all_failed, round(avg(CASE WHEN m <> 0 THEN 1.0 ELSE 0.0 END), 6) AS success_graph, round(avg(CASE WHEN m > 1 THEN 1.0 ELSE 0.0 END), 6) AS success_textual,
      round(avg(x) FILTER (WHERE m <> 0), 6) AS evidence_graph, round(avg(x / 2) FILTER (WHERE m > 1), 6) AS evidence_textual, count(*) FILTER (WHERE m > 1) AS pairs_computed, count(*) FILTER (WHERE m = 4) AS pairs_agreed,
      round(count(*) FILTER (WHERE m = 4) / CAST(count(*) FILTER (WHERE m > 1) AS DOUBLE), 6) AS agreement_rate, round(avg(1.0 + m), 6) AS seconds, count(*) FILTER (WHERE m = 3) AS conflicts FROM q""",
)
def fusion_report(spark, d):
    """Success, evidence, agreement of pairs, conflicts and time of a run, in one row."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), (F.col("o_orderkey") % 5).alias("m"), (F.col("o_orderkey") % 7 / F.lit(7.0)).alias("x"))
    live = o.select("question_id", F.lit("graph").alias("pipeline"), (F.col("m") != 0).alias("success"), F.col("x").alias("evidence_score")).unionByName(
        o.select("question_id", F.lit("textual").alias("pipeline"), (F.col("m") > 1).alias("success"), (F.col("x") / 2).alias("evidence_score"))
    )
    live = live.withColumn("evidence_score", F.when(F.col("success"), F.col("evidence_score")))
    pairs = o.where("m > 1").select("question_id", F.lit("graph_textual").alias("pair"), (F.col("m") == 4).alias("agreement"))
    chosen = o.select("question_id", F.when(F.col("m") == 3, "transitivity_conflict").otherwise("no_agreement").alias("rule"), (1.0 + F.col("m")).alias("seconds"))
    return U.run_report(live, pairs, chosen, ("graph", "textual"))


@register("name_resolution", "SELECT p_partkey AS id, 'Supplier#00000000' || (p_partkey % 10) AS name, CAST(p_partkey % 10 AS BIGINT) AS horse FROM part WHERE p_partkey % 2 = 0")
def name_resolution(spark, d):
    """Names in a question become ids: whole words, whatever the case."""
    asked = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("How is SUPPLIER#00000000"), (F.col("p_partkey") % 10).cast("string"), F.lit("?"))).otherwise("Supplier#00000000").alias("text"))
    names = t(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    found = R.entity_mentions(asked, names, "id", cap=None).drop("place")
    return found.join(names, "name").select("id", "name", F.col("s_suppkey").alias("horse"))


@register(
    "part_mentions",
    """SELECT p_partkey AS id, q AS name FROM (SELECT p_partkey, unnest([p_name, regexp_extract(p_name, '^\\S+'), p_name || ' ' || p_brand]) AS q FROM part WHERE p_partkey % 7 <> 0)
    WHERE q IN (SELECT p_name FROM part UNION ALL SELECT p_name || ' ' || p_brand FROM part)""",
)
def part_mentions(spark, d):
    """As many names as parts, which share their first words, found in as many texts: names that begin others are found too."""
    part = t(spark, d, "part")
    whole = F.concat_ws(" ", "p_name", "p_brand")
    names = part.select(F.col("p_name").alias("name")).union(part.select(whole))
    texts = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("Where is "), F.upper(whole), F.lit("?"))).otherwise(F.concat(F.lit("x"), "p_name", F.lit("x"))).alias("text"))
    return R.entity_mentions(texts, names, "id", cap=None).drop("place")


@register("prose_documents", "SELECT n_name AS nation, 'Nation ' || n_name || '.' || coalesce(chr(10) || chr(10) || 'Suppliers: ' || (SELECT string_agg(s_name || '.', ' ' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS text FROM nation")
def prose_documents(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    sheets = etl.nest(n, "k", suppliers=t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_name"))
    text = etl.render(F.concat(F.lit("Nation "), F.col("nation"), F.lit(".")), ("Suppliers:", "suppliers", lambda s: F.concat(s, F.lit("."))))
    return sheets.select("nation", text.alias("text"))


@register("spot_check", "SELECT * FROM (VALUES ('BUILDING', CAST(7 AS BIGINT), true), ('MACHINERY', 3, true)) v(segment, n, own)")
def spot_check(spark, d):
    """A seeded sample of 7 and 3 (the sizes are the feature); drawn twice, it is the same."""
    draw = lambda: etl.spot_check(t(spark, d, "customer"), "c_custkey", "c_mktsegment", {"BUILDING": 7, "MACHINERY": 3}, 20)
    again = draw().select(F.col("c_custkey").alias("again"))
    both = draw().join(again, F.col("c_custkey") == F.col("again"))
    return both.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.lit(True).alias("own"))


@register(
    "role_phase_gate",
    """SELECT o_custkey, coalesce(bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')), false) AND coalesce(bool_or(o_orderstatus IN ('F', 'P')), false) AND count(DISTINCT o_orderstatus) >= 2 AS fits FROM orders GROUP BY o_custkey""",
)
def role_phase_gate(spark, d):
    """A roll-up by role (here a customer's priorities) and phase (statuses) is made only of known ones, and of two phases or more."""
    return etl.fits_role_phase(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["1-URGENT", "2-HIGH"], ["F", "P"], "o_custkey")
