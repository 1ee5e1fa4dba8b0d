"""Named queries: a knowledge base in graph form, made of the star-schema tables by arithmetic on
their keys; its 14 relational tables; and the benchmark's question shapes, each as a pattern over the
graph and as SQL over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import evaluation as E
from trellis.operators import shapes as S
from trellis.operators import tables as K
from trellis.operators import ties as T
from trellis.operators.graph import Graph, Pattern
from trellis.plans.catalog import register
from trellis.session import table as t


def _id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.expr(key) if isinstance(key, str) else key).cast("string"))


def kb_graph(spark: SparkSession, d: str) -> Graph:
    """Suppliers are horses, customers people, nations events, regions seasons, parts trainings and
    sensors, orders results."""

    def nodes(table: str, ident: Column, labels: str, where: str = "true", **props: str) -> DataFrame:
        pairs = F.map_from_arrays(F.array(*map(F.lit, props)), F.array(*[F.expr(e).cast("string") for e in props.values()]))
        return t(spark, d, table).where(where).select(ident.alias("id"), F.expr(labels).alias("labels"), pairs.alias("props"))

    def one_of(table: str, ident: Column, key: str, labels: tuple[str, ...], more: str = "", **props: str) -> list[DataFrame]:
        """A union with a constant label for each branch, so that a label prunes whole scans."""
        return [nodes(table, ident, f"array({more}'{x}')", f"{key} = {i}", **props) for i, x in enumerate(labels)]

    pick = lambda key, values: f"element_at(array({', '.join(repr(v) for v in values)}), cast({key} as int) + 1)"
    all_nodes = [
        nodes("supplier", _id("H", "s_suppkey"), "array('Horse')", hasName="s_name", hasRace="'Race ' || s_suppkey % 7"),
        nodes("region", _id("Y", "r_regionkey"), "array('CompetitiveSeason')", seasonName="r_name", seasonStart="'2026-01-01'", seasonEnd="'2026-12-31'"),
        *one_of("nation", _id("E", "n_nationkey"), "n_nationkey % 3", K.DISCIPLINES, eventLocation="n_name", category=pick("n_nationkey % 4", CATEGORIES), eventDate="date_add(DATE '2026-01-01', n_nationkey * 9)"),
        *one_of("customer", _id("P", "c_custkey"), "CASE c_custkey % 50 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END", K.ROLES, hasName="c_name"),
        nodes("region", _id("O", "r_regionkey"), "array('ExperimentalObjective')", "r_regionkey < 2", hasName="'Objective ' || r_regionkey", description="r_name"),
        *one_of("part", _id("T", "p_partkey"), "p_partkey % 4", K.STAGES, Volume="p_size || 'min'", Intensity=pick("(p_partkey div 4) % 4", INTENSITIES), Frequency="p_partkey % 6"),
        nodes("orders", _id("R", "o_orderkey"), "array('EventParticipation')", rank="o_orderkey % 15 + 1", status="CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'retired' ELSE 'eliminated' END"),
        *one_of(
            "part", _id("S", "p_partkey"), "p_partkey % 4", K.POSITIONS, "'InertialSensors', ", hasSensorID="'IMU' || p_partkey", hasFormat="'csv'", hasSensorOffset="'0.0' || p_partkey % 9",
            hasFileSize="p_size * 1000", hasSensorTime=pick("p_partkey % 3", ["100Hz", "250Hz", "500Hz"]),
        ),
    ]

    def edges(table: str, type_: str, a: Column, b: Column, where: str = "true") -> DataFrame:
        return t(spark, d, table).where(where).select(a.alias("src"), F.lit(type_).alias("type"), b.alias("dst"))

    all_edges = [
        edges("nation", "INSEASON", _id("E", "n_nationkey"), _id("Y", "n_regionkey"), "n_nationkey % 10 <> 9"),
        edges("supplier", "COMPETESIN", _id("H", "s_suppkey"), _id("E", "s_nationkey")),
        edges("part", "TRAINSIN", _id("H", "p_partkey % 10"), _id("T", "p_partkey")),
        edges("part", "DEPENDSON", _id("T", "p_partkey"), _id("E", "p_partkey % 25"), "p_partkey % 3 <> 0"),
        edges("part", "INVOLVESACTOR", _id("T", "p_partkey"), _id("P", "p_partkey % 48 + 2")),
        edges("part", "INVOLVESACTOR", _id("T", "p_partkey"), _id("P", "p_partkey % 3 * 50"), "p_partkey % 4 < 2"),
        edges("part", "INVOLVESACTOR", _id("T", "p_partkey"), _id("P", "p_partkey % 3 * 50 + 1"), "p_partkey % 4 = 0"),
        edges("orders", "HASPARTICIPATION", _id("E", "o_custkey % 25"), _id("R", "o_orderkey")),
        edges("orders", "HASHORSE", _id("R", "o_orderkey"), _id("H", "o_custkey % 10")),
        edges("orders", "HASRIDER", _id("R", "o_orderkey"), _id("P", "o_custkey")),
        edges("part", "ISATTACHEDTO", _id("S", "p_partkey"), _id("H", "p_partkey % 10")),
        edges("part", "ISUSEDFOR", _id("S", "p_partkey"), _id("O", "p_partkey % 2"), "p_partkey % 5 <> 0"),
        edges("customer", "ASSOCIATEDWITH", _id("P", "c_custkey"), _id("H", "c_custkey % 10"), "c_custkey % 50 > 1"),
    ]
    union = lambda frames: reduce(lambda x, y: x.unionByName(y), frames)
    return Graph(union(all_nodes), union(all_edges))


CATEGORIES = ["Amateur 1", "Amateur 2", "Club Elite", "Pro Elite"]
INTENSITIES = ["Faible", "Modérée", "Élevée", "Pic"]

_ROLE = "CASE c_custkey % 50 WHEN 0 THEN 'Veterinarian' WHEN 1 THEN 'Caretaker' ELSE 'Rider' END"
_ACTORS = """SELECT p_partkey AS k, p_partkey % 48 + 2 AS a FROM part UNION SELECT p_partkey, p_partkey % 3 * 50 FROM part WHERE p_partkey % 4 < 2
 UNION SELECT p_partkey, p_partkey % 3 * 50 + 1 FROM part WHERE p_partkey % 4 = 0"""
#: The same 14 tables as SQL over the star schema.
TABLES = f"""WITH horses AS (SELECT 'H' || s_suppkey AS horse_id, s_name AS name, 'Race ' || (s_suppkey % 7) AS race FROM supplier),
seasons AS (SELECT 'Y' || r_regionkey AS season_id, r_name AS season_name, '2026-01-01' AS season_start, '2026-12-31' AS season_end FROM region),
events AS (SELECT 'E' || n_nationkey AS event_id, n_name AS location, {CATEGORIES}[n_nationkey % 4 + 1] AS category, strftime(DATE '2026-01-01' + CAST(n_nationkey * 9 AS INTEGER), '%Y-%m-%d') AS event_date,
  {list(K.DISCIPLINES)}[n_nationkey % 3 + 1] AS discipline, 'Y' || n_regionkey AS season_id FROM nation WHERE n_nationkey % 10 <> 9),
people AS (SELECT 'P' || c_custkey AS person_id, {_ROLE} AS role FROM customer),
riders AS (SELECT person_id FROM people WHERE role = 'Rider'), veterinarians AS (SELECT person_id FROM people WHERE role = 'Veterinarian'), caretakers AS (SELECT person_id FROM people WHERE role = 'Caretaker'),
objectives AS (SELECT 'O' || r_regionkey AS objective_id, 'Objective ' || r_regionkey AS name, r_name AS description FROM region WHERE r_regionkey < 2),
event_entries AS (SELECT 'H' || s_suppkey AS horse_id, 'E' || s_nationkey AS event_id FROM supplier),
trainings AS (SELECT 'T' || p_partkey AS training_id, 'H' || (p_partkey % 10) AS horse_id, CASE WHEN p_partkey % 3 <> 0 THEN 'E' || (p_partkey % 25) END AS event_id, {list(K.STAGES)}[p_partkey % 4 + 1] AS stage_type,
  p_size || 'min' AS volume, p_size AS volume_minutes, {INTENSITIES}[(p_partkey // 4) % 4 + 1] AS intensity, CAST(p_partkey % 6 AS INTEGER) AS frequency FROM part),
training_actors AS (SELECT 'T' || k AS training_id, 'P' || a AS actor_id, {_ROLE} AS actor_role FROM ({_ACTORS}) JOIN customer ON c_custkey = a),
event_participations AS (SELECT 'R' || o_orderkey AS participation_id, 'E' || (o_custkey % 25) AS event_id, 'H' || (o_custkey % 10) AS horse_id, 'P' || o_custkey AS rider_id, CAST(o_orderkey % 15 + 1 AS INTEGER) AS rank,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'retired' ELSE 'eliminated' END AS status FROM orders WHERE o_custkey % 50 > 1),
sensors AS (SELECT 'S' || p_partkey AS sensor_id, 'H' || (p_partkey % 10) AS horse_id, {list(K.POSITIONS)}[p_partkey % 4 + 1] AS sensor_type, 'IMU' || p_partkey AS sensor_code, 'csv' AS format, '0.0' || (p_partkey % 9) AS sensor_offset,
  (p_partkey % 9) / 100.0 AS sensor_offset_value, p_size * 1000 AS file_size, ['100Hz', '250Hz', '500Hz'][p_partkey % 3 + 1] AS sample_rate, [100, 250, 500][p_partkey % 3 + 1] AS sample_rate_hz,
  CASE WHEN p_partkey % 5 <> 0 THEN 'O' || (p_partkey % 2) END AS objective_id FROM part),
horse_rider_associations AS (SELECT 'P' || c_custkey AS rider_id, 'H' || (c_custkey % 10) AS horse_id FROM customer WHERE c_custkey % 50 > 1)
"""


def _register_table(name: str) -> None:
    register(f"kb_{name}", f"{TABLES} SELECT * FROM {name}")(lambda spark, d: K.tables_of(kb_graph(spark, d))[name])


for _name in K.KEYS:
    _register_table(_name)


@register("kb_rederived", f"{TABLES} " + " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n, CAST(0 AS BIGINT) AS differences FROM {x}" for x in ("events", "trainings", "training_actors", "sensors", "event_entries", "event_participations")))
def kb_rederived(spark, d):
    """Tables made twice, by specs and by patterns, compared field by field: how many rows, how many differences."""
    g = kb_graph(spark, d)
    first, out = K.tables_of(g), []
    for name, again in K.derive_again(g).items():
        fields = [c for c in again.columns if c not in K.KEYS[name]]
        left = first[name].select(*[F.col(c).cast("string").alias(c) for c in again.columns])
        right = again.select(*[F.col(c).cast("string").alias(c) for c in again.columns])
        differ = S.keyed_diff(left, right, K.KEYS[name], fields).agg(F.count("*").alias("differences"))
        out.append(left.agg(F.count("*").alias("n")).crossJoin(differ).select(F.lit(name).alias("name"), "n", "differences"))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("kb_changed", f"{TABLES} SELECT training_id, 'mismatch' AS kind, 'intensity' AS field, intensity AS left_value, 'Pic' AS right_value FROM trainings WHERE frequency = 5 AND intensity <> 'Pic' UNION ALL SELECT training_id, 'missing_right', NULL, NULL, NULL FROM trainings WHERE frequency = 4")
def kb_changed(spark, d):
    """The full diff finds planted changes: a changed field, and missing rows."""
    trainings = K.tables_of(kb_graph(spark, d))["trainings"]
    other = trainings.where("frequency <> 4").withColumn("intensity", F.when(F.col("frequency") == 5, "Pic").otherwise(F.col("intensity")))
    return S.keyed_diff(trainings, other, ["training_id"], ["intensity", "stage_type", "horse_id"])


# ---- question shapes ----------------------------------------------------------------------


def gold(number: int, sql: str):
    """A question: fn(g) over the graph gives the rows of the SQL over the tables."""

    def wrap(fn):
        register(f"gold_q{number:03d}", f"{TABLES} {sql}")(lambda spark, d: fn(kb_graph(spark, d)))
        return fn

    return wrap


def prop(name: str) -> Column:
    return F.element_at("props", F.lit(name))


def listed(column: str) -> Column:
    """Distinct values in order, as one text."""
    return F.array_join(F.sort_array(F.collect_set(column)), ",")


_LIST = "array_to_string(list_sort(list(DISTINCT {})), ',')"


def stages(g: Graph) -> DataFrame:
    """horse, training, its stage and properties."""
    rows = g.match("h", "Horse").out("h", "TRAINSIN", "t", *K.STAGES).table()
    return g.props(g.labels_of(rows, "t", "stage", *K.STAGES, at=0), "t", *K.STAGES, volume="Volume", intensity="Intensity", frequency="Frequency")


def results(g: Graph) -> Pattern:
    """e, p, h, r: official results."""
    return g.match("p", "EventParticipation").into("p", "HASPARTICIPATION", "e").out("p", "HASHORSE", "h", "Horse").out("p", "HASRIDER", "r", "Rider")


def ranked(g: Graph) -> DataFrame:
    rows = g.props(results(g).table(), "p", "EventParticipation", rank="rank", status="status")
    return rows.withColumn("rank", F.col("rank").cast("int"))


@gold(1, "SELECT DISTINCT race FROM horses")
def q1(g):
    return g.label("Horse").select(prop("hasRace").alias("race")).distinct()


@gold(2, "SELECT race FROM horses WHERE name = 'Supplier#000000003'")
def q2(g):
    return g.label("Horse").where(prop("hasName") == "Supplier#000000003").select(prop("hasRace").alias("race"))


@gold(4, "SELECT DISTINCT event_id FROM event_entries WHERE horse_id = 'H3'")
def q4(g):
    return g.match("h", "Horse", where=F.col("id") == "H3").out("h", "COMPETESIN", "e").table().select(F.col("e").alias("event_id")).distinct()


@gold(5, f"SELECT count(DISTINCT training_id) AS n, {_LIST.format('stage_type')} AS stages FROM trainings WHERE horse_id = 'H3'")
def q5(g):
    return stages(g).where("h = 'H3'").agg(F.count_distinct("t").alias("n"), listed("stage").alias("stages"))


@gold(6, f"SELECT frequency, count(DISTINCT horse_id) AS n, {_LIST.format('horse_id')} AS horses FROM trainings WHERE stage_type = 'PreparationStage' GROUP BY 1")
def q6(g):
    return stages(g).where("stage = 'PreparationStage'").groupBy(F.col("frequency").cast("int").alias("frequency")).agg(F.count_distinct("h").alias("n"), listed("h").alias("horses"))


@gold(7, "SELECT DISTINCT volume, intensity FROM trainings WHERE stage_type = 'TransitionStage'")
def q7(g):
    return g.label("TransitionStage").select(prop("Volume").alias("volume"), prop("Intensity").alias("intensity")).distinct()


@gold(8, "SELECT volume, count(DISTINCT training_id) AS n, count(DISTINCT horse_id) AS horses FROM trainings WHERE stage_type = 'CompetitionStage' GROUP BY 1")
def q8(g):
    return stages(g).where("stage = 'CompetitionStage'").groupBy("volume").agg(F.count_distinct("t").alias("n"), F.count_distinct("h").alias("horses"))


@gold(10, "SELECT DISTINCT p.horse_id, p.event_id, e.discipline, e.location, e.season_id, p.status FROM event_participations p JOIN events e USING (event_id) WHERE p.rank = 1")
def q10(g):
    rows = ranked(g).where("rank = 1").join(g.match("e", *K.DISCIPLINES).out("e", "INSEASON", "y").table(), "e")
    rows = g.props(g.labels_of(rows, "e", "discipline", *K.DISCIPLINES, at=0), "e", *K.DISCIPLINES, location="eventLocation")
    return rows.select(F.col("h").alias("horse_id"), F.col("e").alias("event_id"), "discipline", "location", F.col("y").alias("season_id"), "status").distinct()


@gold(11, "SELECT count(DISTINCT horse_id) AS n FROM event_participations WHERE event_id = 'E7'")
def q11(g):
    return results(g).where("e = 'E7'").table().agg(F.count_distinct("h").alias("n"))


@gold(12, "SELECT sensor_type, count(*) AS n, count(DISTINCT horse_id) AS horses FROM sensors GROUP BY 1")
def q12(g):
    rows = g.labels_of(g.match("s", K.GENERIC_SENSOR).out("s", "ISATTACHEDTO", "h").table(), "s", "sensor_type", K.GENERIC_SENSOR, at=1)
    return rows.groupBy("sensor_type").agg(F.count("*").alias("n"), F.count_distinct("h").alias("horses"))


@gold(13, "SELECT DISTINCT sensor_type FROM sensors")
def q13(g):
    return g.label(K.GENERIC_SENSOR).select(F.get("labels", F.lit(1)).alias("sensor_type")).distinct()


@gold(14, "SELECT count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM events WHERE lower(category) = 'pro elite'")
def q14(g):
    rows = g.match("e", *K.DISCIPLINES, where=F.lower(prop("category")) == "pro elite").out("e", "INSEASON", "y").table()
    return rows.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("e")), ",").alias("ids"))


@gold(16, "SELECT training_id, volume_minutes FROM trainings WHERE volume_minutes = (SELECT max(volume_minutes) FROM trainings)")
def q16(g):
    minutes = g.label(*K.STAGES).select(F.col("id").alias("training_id"), F.replace(prop("Volume"), F.lit("min"), F.lit("")).cast("int").alias("volume_minutes"))
    return T.argmax_all(minutes, "volume_minutes")


@gold(19, "SELECT count(*) AS n FROM people WHERE role = 'Rider'")
def q19(g):
    return g.label("Rider").agg(F.count("*").alias("n"))


@gold(22, "SELECT DISTINCT a.actor_id FROM training_actors a JOIN trainings t USING (training_id) JOIN horses h USING (horse_id) WHERE lower(h.name) = 'supplier#000000004' AND a.actor_role <> 'Rider'")
def q22(g):
    p = g.match("h", "Horse", where=F.lower(prop("hasName")) == "supplier#000000004").out("h", "TRAINSIN", "t").out("t", "INVOLVESACTOR", "a", "Veterinarian", "Caretaker")
    return p.table().select(F.col("a").alias("actor_id")).distinct()


@gold(24, "SELECT horse_id, race FROM horses WHERE name = 'Supplier#000000005' OR horse_id = 'H6'")
def q24(g):
    return g.label("Horse").where((prop("hasName") == "Supplier#000000005") | (F.col("id") == "H6")).select(F.col("id").alias("horse_id"), prop("hasRace").alias("race"))


@gold(26, "SELECT event_date FROM events WHERE event_id = 'E12'")
def q26(g):
    return g.nodes.where("id = 'E12'").select(prop("eventDate").alias("event_date"))


@gold(31, "SELECT rank, status FROM event_participations WHERE horse_id = 'H4' AND event_id = 'E14'")
def q31(g):
    """Three matches that share the result."""
    at = g.match("e", where=F.col("id") == "E14").out("e", "HASPARTICIPATION", "p", "EventParticipation")
    by = g.match("h", "Horse", where=F.col("id") == "H4").into("h", "HASHORSE", "p")
    ridden = g.match("p", "EventParticipation").out("p", "HASRIDER", "r", "Rider")
    return g.props(at.join(by).join(ridden).table(), "p", "EventParticipation", rank="rank", status="status").select(F.col("rank").cast("int").alias("rank"), "status")


@gold(33, "SELECT stage_type, volume, intensity, frequency, count(DISTINCT horse_id) AS n FROM trainings GROUP BY ALL")
def q33(g):
    return stages(g).groupBy(F.col("stage").alias("stage_type"), "volume", "intensity", F.col("frequency").cast("int").alias("frequency")).agg(F.count_distinct("h").alias("n"))


@gold(34, "SELECT DISTINCT t.horse_id, a.actor_id, a.actor_role FROM training_actors a JOIN trainings t USING (training_id) WHERE t.intensity = 'Pic' ORDER BY 1, 2")
def q34(g):
    rows = g.match("h", "Horse").out("h", "TRAINSIN", "t", *K.STAGES, where=prop("Intensity") == "Pic").out("t", "INVOLVESACTOR", "a", *K.ROLES).table()
    rows = g.labels_of(rows, "a", "actor_role", *K.ROLES, at=0)
    return rows.select(F.col("h").alias("horse_id"), F.col("a").alias("actor_id"), "actor_role").distinct().orderBy("horse_id", "actor_id")


@gold(36, "SELECT count(*) AS n FROM people")
def q36(g):
    return g.label(*K.ROLES).agg(F.count("*").alias("n"))


@gold(37, "SELECT DISTINCT discipline FROM events")
def q37(g):
    return g.label(*K.DISCIPLINES).select(F.get("labels", F.lit(0)).alias("discipline")).distinct()


@gold(41, "SELECT horse_id, n FROM (SELECT horse_id, count(*) AS n FROM trainings GROUP BY 1) WHERE n = (SELECT max(c) FROM (SELECT count(*) AS c FROM trainings GROUP BY horse_id))")
def q41(g):
    return T.argmax_all(stages(g).groupBy(F.col("h").alias("horse_id")).agg(F.count("*").alias("n")), "n")


@gold(42, "SELECT stage_type, intensity, volume FROM trainings GROUP BY ALL HAVING count(*) = 1")
def q42(g):
    return stages(g).groupBy(F.col("stage").alias("stage_type"), "intensity", "volume").agg(F.count("*").alias("n")).where("n = 1").drop("n")


@gold(43, f"SELECT n, count(*) AS horses, {_LIST.format('horse_id')} AS ids FROM (SELECT horse_id, count(DISTINCT rider_id) AS n FROM horse_rider_associations GROUP BY 1) GROUP BY n")
def q43(g):
    sizes = g.match("r", "Rider").out("r", "ASSOCIATEDWITH", "h", "Horse").counts(["h"], n="r")
    return sizes.groupBy("n").agg(F.count("*").alias("horses"), listed("h").alias("ids"))


@gold(44, "SELECT horse_id, count(DISTINCT rider_id) AS n FROM event_participations GROUP BY 1 HAVING count(DISTINCT rider_id) > 1")
def q44(g):
    return results(g).counts(["h"], n="r").where("n > 1").withColumnRenamed("h", "horse_id")


@gold(47, "SELECT n, count(*) AS horses FROM (SELECT horse_id, count(*) AS n FROM sensors GROUP BY 1) GROUP BY n")
def q47(g):
    return S.histogram_of_counts(g.match("s", K.GENERIC_SENSOR).out("s", "ISATTACHEDTO", "h").table(), "h").select(F.col("size").alias("n"), F.col("n_keys").alias("horses"))


@gold(48, "SELECT objective_id, sensor_type, count(*) AS n FROM sensors WHERE objective_id IS NOT NULL GROUP BY ALL")
def q48(g):
    rows = g.match("o", "ExperimentalObjective").into("o", "ISUSEDFOR", "s", K.GENERIC_SENSOR).table()
    return g.labels_of(rows, "s", "sensor_type", K.GENERIC_SENSOR, at=1).groupBy(F.col("o").alias("objective_id"), "sensor_type").agg(F.count("*").alias("n"))


@gold(49, "SELECT sample_rate, count(*) AS n FROM sensors GROUP BY 1")
def q49(g):
    return g.label(K.GENERIC_SENSOR).groupBy(prop("hasSensorTime").alias("sample_rate")).agg(F.count("*").alias("n"))


@gold(56, "SELECT t.stage_type, a.actor_role, count(DISTINCT a.actor_id) AS n FROM training_actors a JOIN trainings t USING (training_id) WHERE t.stage_type IN ('PreparationStage', 'CompetitionStage') GROUP BY ALL")
def q56(g):
    rows = g.match("t", "PreparationStage", "CompetitionStage").out("t", "INVOLVESACTOR", "a", *K.ROLES).table()
    rows = g.labels_of(g.labels_of(rows, "t", "stage_type", *K.STAGES, at=0), "a", "actor_role", *K.ROLES, at=0)
    return rows.groupBy("stage_type", "actor_role").agg(F.count_distinct("a").alias("n"))


@gold(57, "SELECT horse_id FROM horses WHERE horse_id NOT IN (SELECT horse_id FROM trainings WHERE intensity = 'Faible' AND frequency = 2)")
def q57(g):
    faint = g.match("h", "Horse").out("h", "TRAINSIN", "t", where=(prop("Intensity") == "Faible") & (prop("Frequency") == "2"))
    return g.match("h", "Horse").without(faint).table().select(F.col("h").alias("horse_id"))


@gold(59, ", m AS (SELECT substring(event_date, 1, 7) AS month, count(*) AS n FROM events GROUP BY 1) SELECT month, n FROM m WHERE n = (SELECT max(n) FROM m)")
def q59(g):
    rows = g.match("e", *K.DISCIPLINES).out("e", "INSEASON", "y").table()
    months = g.props(rows, "e", *K.DISCIPLINES, day="eventDate").groupBy(F.substring("day", 1, 7).alias("month")).agg(F.count("*").alias("n"))
    return T.argmax_all(months, "n")


@gold(62, "SELECT DISTINCT h.horse_id FROM horses h LEFT JOIN event_entries n ON n.horse_id = h.horse_id LEFT JOIN event_participations p ON p.horse_id = n.horse_id AND p.event_id = n.event_id WHERE p.participation_id IS NULL")
def q62(g):
    """Engaged without a result in that event."""
    engaged = g.match("h", "Horse").out("h", "COMPETESIN", "e")
    return engaged.without(results(g)).table().select(F.col("h").alias("horse_id")).distinct()


@gold(63, "SELECT rider_id, count(*) AS n FROM event_participations GROUP BY 1 HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM event_participations GROUP BY rider_id))")
def q63(g):
    return T.argmax_all(results(g).table().groupBy(F.col("r").alias("rider_id")).agg(F.count("*").alias("n")), "n")


@gold(65, "SELECT t.training_id, (SELECT count(*) FROM trainings) AS total FROM trainings t LEFT JOIN training_actors a ON a.training_id = t.training_id AND a.actor_role = 'Veterinarian' WHERE a.actor_id IS NULL")
def q65(g):
    treated = g.match("t", *K.STAGES).out("t", "INVOLVESACTOR", "a", "Veterinarian")
    alone = g.match("t", *K.STAGES).without(treated).table().select(F.col("t").alias("training_id"))
    return alone.crossJoin(F.broadcast(g.label(*K.STAGES).agg(F.count("*").alias("total"))))


@gold(66, "SELECT training_id FROM trainings WHERE (horse_id, stage_type) IN (SELECT (horse_id, stage_type) FROM trainings WHERE frequency = 0 GROUP BY horse_id, stage_type HAVING count(*) > 1)")
def q66(g):
    rows = stages(g)
    again = rows.where("frequency = '0'").groupBy("h", "stage").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(again, ["h", "stage"], "left_semi").select(F.col("t").alias("training_id"))


@gold(67, "SELECT h.horse_id FROM horses h WHERE (SELECT count(*) FROM event_participations p WHERE p.horse_id = h.horse_id AND p.event_id = 'E7') = 0")
def q67(g):
    at = results(g).where("e = 'E7'")
    return g.match("h", "Horse").without(at).table().select(F.col("h").alias("horse_id"))


@gold(69, "SELECT 'HASRIDER' AS type, count(*) AS n FROM orders UNION ALL SELECT 'COMPETESIN', count(*) FROM event_entries UNION ALL SELECT 'INVOLVESACTOR', count(*) FROM training_actors UNION ALL SELECT 'ISUSEDFOR', count(*) FROM sensors WHERE objective_id IS NOT NULL")
def q69(g):
    return g.type_counts().where(F.col("type").isin("HASRIDER", "COMPETESIN", "INVOLVESACTOR", "ISUSEDFOR"))


@gold(74, "SELECT count(*) AS n FROM trainings WHERE volume IS NULL OR NOT regexp_matches(volume, '^[1-4][0-9]min$')")
def q74(g):
    return g.label(*K.STAGES).where(prop("Volume").isNull() | ~prop("Volume").rlike("^[1-4][0-9]min$")).agg(F.count("*").alias("n"))


@gold(76, "SELECT DISTINCT actor_role FROM training_actors a JOIN trainings t USING (training_id) WHERE t.stage_type <> 'PreparationStage'")
def q76(g):
    rows = g.match("t", *K.STAGES[1:]).out("t", "INVOLVESACTOR", "a", *K.ROLES).table()
    return g.labels_of(rows, "a", "actor_role", *K.ROLES, at=0).select("actor_role").distinct()


@gold(79, "SELECT DISTINCT status FROM event_participations WHERE rank > 10")
def q79(g):
    return ranked(g).where("rank > 10").groupBy("status").agg(F.count("*").alias("n")).select("status")


@gold(80, "SELECT event_id, event_date FROM events WHERE event_date = (SELECT min(event_date) FROM events) OR event_date = (SELECT max(event_date) FROM events)")
def q80(g):
    rows = g.match("e", *K.DISCIPLINES).out("e", "INSEASON", "y").table()
    return T.first_and_last(g.props(rows, "e", *K.DISCIPLINES, event_date="eventDate").select(F.col("e").alias("event_id"), "event_date"), "event_date")


@gold(82, "SELECT DISTINCT o.name FROM sensors s JOIN objectives o USING (objective_id) WHERE s.horse_id = 'H4'")
def q82(g):
    rows = g.match("h", "Horse", where=F.col("id") == "H4").into("h", "ISATTACHEDTO", "s", K.GENERIC_SENSOR).out("s", "ISUSEDFOR", "o").table()
    return g.props(rows, "o", "ExperimentalObjective", name="hasName").select("name").distinct()


@gold(83, "SELECT DISTINCT sensor_offset FROM sensors WHERE sensor_offset = (SELECT max(sensor_offset) FROM sensors)")
def q83(g):
    return T.argmax_all(g.label(K.GENERIC_SENSOR).select(prop("hasSensorOffset").alias("sensor_offset")).distinct(), "sensor_offset")


@gold(85, "SELECT sensor_id FROM sensors WHERE sensor_offset = (SELECT min(sensor_offset) FROM sensors) OR sample_rate = (SELECT min(sample_rate) FROM sensors)")
def q85(g):
    rows = g.label(K.GENERIC_SENSOR).select(F.col("id").alias("sensor_id"), prop("hasSensorOffset").alias("o"), prop("hasSensorTime").alias("s"))
    least = rows.agg(F.min("o").alias("lo"), F.min("s").alias("ls"))
    return rows.join(F.broadcast(least), (F.col("o") == F.col("lo")) | (F.col("s") == F.col("ls")), "left_semi").select("sensor_id")


@gold(86, "SELECT e.event_id, (SELECT count(*) FROM event_entries n WHERE n.event_id = e.event_id) AS entries, (SELECT count(DISTINCT horse_id) FROM event_participations p WHERE p.event_id = e.event_id) AS horses FROM events e")
def q86(g):
    """Two optional branches, counted apart."""
    base = g.match("e", *K.DISCIPLINES).out("e", "INSEASON", "y").table().select("e")
    entries = g.match("h", "Horse").out("h", "COMPETESIN", "e").table().select("e", "h")
    return S.left_counts(base, "e", entries=entries, horses=results(g).table().select("e", "h")).withColumnRenamed("e", "event_id")


@gold(87, "SELECT t.training_id, t.event_id IS NULL AS no_event, count(DISTINCT a.actor_id) AS vets FROM trainings t LEFT JOIN training_actors a ON a.training_id = t.training_id AND a.actor_role = 'Veterinarian' WHERE t.frequency = 3 GROUP BY ALL HAVING t.event_id IS NULL OR count(a.actor_id) = 0")
def q87(g):
    """Rows with a gap in either optional branch."""
    thrice = g.match("t", *K.STAGES, where=prop("Frequency") == "3")
    tied = thrice.optional(g.match("t", *K.STAGES).out("t", "DEPENDSON", "e")).table()
    counted = S.left_counts(tied, "t", vets=g.match("t", *K.STAGES).out("t", "INVOLVESACTOR", "a", "Veterinarian").table().select("t", "a"))
    return counted.select(F.col("t").alias("training_id"), F.col("e").isNull().alias("no_event"), "vets").where("no_event or vets = 0")


@gold(91, "SELECT n.horse_id, n.event_id, count(p.participation_id) AS results FROM event_entries n LEFT JOIN event_participations p ON p.horse_id = n.horse_id AND p.event_id = n.event_id GROUP BY ALL")
def q91(g):
    joined = g.match("h", "Horse").out("h", "COMPETESIN", "e").optional(results(g)).table()
    return joined.groupBy(F.col("h").alias("horse_id"), F.col("e").alias("event_id")).agg(F.count("p").alias("results"))


@gold(92, ", c AS (SELECT n, count(*) AS horses FROM (SELECT horse_id, count(*) AS n FROM trainings GROUP BY 1) GROUP BY n) SELECT n, horses FROM c WHERE n = (SELECT min(n) FROM c)")
def q92(g):
    sizes = S.histogram_of_counts(stages(g), "h").select(F.col("size").alias("n"), F.col("n_keys").alias("horses"))
    return sizes.orderBy("n").limit(1)


@gold(93, ", c AS (SELECT h.horse_id, (SELECT count(*) FROM trainings t WHERE t.horse_id = h.horse_id) AS trainings, (SELECT count(*) FROM sensors s WHERE s.horse_id = h.horse_id) AS sensors FROM horses h) SELECT trainings, sensors, count(*) AS horses FROM c GROUP BY ALL")
def q93(g):
    base = g.match("h", "Horse").table()
    counted = S.left_counts(base, "h", trainings=stages(g).select("h", "t"), sensors=g.match("s", K.GENERIC_SENSOR).out("s", "ISATTACHEDTO", "h").table().select("h", "s"))
    return counted.groupBy("trainings", "sensors").agg(F.count("*").alias("horses"))


@gold(94, f"SELECT stage_type, {_LIST.format('intensity')} AS intensities FROM trainings WHERE intensity IN ('Pic', 'Faible') GROUP BY 1")
def q94(g):
    return stages(g).where(F.col("intensity").isin("Pic", "Faible")).groupBy(F.col("stage").alias("stage_type")).agg(listed("intensity").alias("intensities"))


@gold(95, "SELECT e.discipline, p.status, count(*) AS n FROM event_participations p JOIN events e USING (event_id) GROUP BY ALL")
def q95(g):
    rows = ranked(g).join(g.match("e", *K.DISCIPLINES).out("e", "INSEASON", "y").table(), "e")
    return g.labels_of(rows, "e", "discipline", *K.DISCIPLINES, at=0).groupBy("discipline", "status").agg(F.count("*").alias("n"))


@gold(96, "SELECT event_id FROM event_participations WHERE rank IN (1, 2) GROUP BY 1 HAVING count(DISTINCT rank) = 2")
def q96(g):
    """The first and the second of one event, two different results."""
    first, second = ranked(g).where("rank = 1").select("e"), ranked(g).where("rank = 2").select("e")
    return first.distinct().join(second.distinct(), "e").select(F.col("e").alias("event_id"))


@gold(97, ", c AS (SELECT horse_id, count(*) AS n FROM trainings GROUP BY 1) SELECT n, array_to_string(list_sort(list(horse_id))[1:3], ',') AS first_three, list_sort(list(horse_id))[-1] AS last, round(100.0 * count(*) / (SELECT count(*) FROM horses), 4) AS pct FROM c GROUP BY n")
def q97(g):
    """A slice, and the last element."""
    sizes = stages(g).groupBy("h").agg(F.count("*").alias("n")).groupBy("n").agg(F.sort_array(F.collect_list("h")).alias("ids"))
    total = g.label("Horse").agg(F.count("*").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("n", F.array_join(F.slice("ids", 1, 3), ",").alias("first_three"), F.element_at("ids", -1).alias("last"), F.round(100.0 * F.size("ids") / F.col("total"), 4).alias("pct"))


@gold(99, "SELECT (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT event_id) FROM event_participations) AS with_results")
def q99(g):
    held = g.match("e", *K.DISCIPLINES).out("e", "INSEASON", "y").table()
    return S.single_row(events=held.agg(F.count("*").alias("n")), with_results=results(g).table().agg(F.count_distinct("e").alias("n")))


@gold(100, "SELECT (SELECT count(*) FROM horses) AS horses, (SELECT count(*) FROM people) AS people, (SELECT count(*) FROM trainings) AS trainings, (SELECT count(*) FROM sensors) AS sensors")
def q100(g):
    count = lambda *labels: g.label(*labels).agg(F.count("*").alias("n"))
    return S.single_row(horses=count("Horse"), people=count(*K.ROLES), trainings=count(*K.STAGES), sensors=count(K.GENERIC_SENSOR))


# ---- the graph's own functions ------------------------------------------------------------


@register("coalesced_properties", f"{TABLES} SELECT horse_id AS id, name AS title FROM horses UNION ALL SELECT event_id, location FROM events UNION ALL SELECT season_id, season_name FROM seasons")
def coalesced_properties(spark, d):
    """The first property that is set, over nodes of several kinds."""
    g = kb_graph(spark, d)
    in_season = g.match("id", *K.DISCIPLINES).out("id", "INSEASON", "y").table().select("id")
    ids = g.match("id", "Horse", "CompetitiveSeason").table().unionByName(in_season)
    return g.props(ids, "id", "Horse", "CompetitiveSeason", *K.DISCIPLINES, title=("hasName", "eventLocation", "seasonName")).select("id", "title")


@register("answers_compared", f"{TABLES} SELECT 'events' AS question, true AS same, true AS contained UNION ALL SELECT 'horses', false, false")
def answers_compared(spark, d):
    """Two answers against their gold rows: columns in another order are the same, a changed value is not."""
    tables = K.tables_of(kb_graph(spark, d))
    events, horses = tables["events"].select("event_id", "location"), tables["horses"].select("horse_id", "race")
    pairs = {"events": (events, events.select("location", F.col("event_id").alias("id"))), "horses": (horses, horses.withColumn("race", F.lit("Race 1")))}
    rows = [(name, E.same_result(a, b), E.multiset_difference(E.unordered_tokens(a), E.unordered_tokens(b)).isEmpty()) for name, (a, b) in pairs.items()]
    return spark.createDataFrame(rows, "question string, same boolean, contained boolean")
