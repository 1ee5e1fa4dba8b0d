"""The relational tables of an equestrian knowledge base, from its property graph.

Twelve tables are nodes or edges as ``etl.TableSpec`` and ``project_relation``
say; what needs two or three hops (participations, actors with their roles,
sensors with a horse) is a pattern. Links that the model requires are inner
joins, optional ones left joins. ``derive_again`` makes the same tables by other
means (patterns only), so that a full diff of both checks each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import first_of, first_other, leading_int, leading_real
from trellis.operators.etl import Link, TableSpec, project_relation, project_table
from trellis.operators.graph import Graph

#: The labels of the model.
STAGES = ("PreparationStage", "PreCompetitionStage", "CompetitionStage", "TransitionStage")
ROLES = ("Rider", "Veterinarian", "Caretaker")
DISCIPLINES = ("ShowJumping", "Dressage", "Cross")
POSITIONS = ("Withers", "Sternum", "CanonOfForelimb", "CanonOfHindlimb")
GENERIC_SENSOR = "InertialSensors"

KEYS = {
    "horses": ["horse_id"], "seasons": ["season_id"], "events": ["event_id"], "people": ["person_id"], "riders": ["person_id"], "veterinarians": ["person_id"],
    "caretakers": ["person_id"], "objectives": ["objective_id"], "event_entries": ["horse_id", "event_id"], "trainings": ["training_id"],
    "training_actors": ["training_id", "actor_id"], "event_participations": ["participation_id"], "sensors": ["sensor_id"], "horse_rider_associations": ["rider_id", "horse_id"],
}

SPECS = [
    TableSpec("horses", ("Horse",), "horse_id", {"name": "hasName", "race": "hasRace"}),
    TableSpec("seasons", ("CompetitiveSeason",), "season_id", {"season_name": "seasonName", "season_start": "seasonStart", "season_end": "seasonEnd"}),
    TableSpec("events", DISCIPLINES, "event_id", {"location": "eventLocation", "category": "category", "event_date": "eventDate"}, (Link("season_id", "INSEASON", required=True),), "discipline"),
    TableSpec("people", ROLES, "person_id", {}, (), "role"),
    TableSpec("objectives", ("ExperimentalObjective",), "objective_id", {"name": "hasName", "description": "description"}),
    TableSpec(
        "trainings", STAGES, "training_id", {"volume": "Volume", "intensity": "Intensity", "frequency": "Frequency"},
        (Link("horse_id", "TRAINSIN", forward=False, required=True), Link("event_id", "DEPENDSON")), "stage_type",
        {"volume_minutes": lambda: leading_int(F.col("volume")), "frequency": lambda: F.col("frequency").try_cast("int")},
    ),
    TableSpec(
        "sensors", (GENERIC_SENSOR,), "sensor_id", {"sensor_code": "hasSensorID", "format": "hasFormat", "sensor_offset": "hasSensorOffset", "file_size": "hasFileSize", "sample_rate": "hasSensorTime"},
        (Link("horse_id", "ISATTACHEDTO", required=True), Link("objective_id", "ISUSEDFOR")), None,
        {"sensor_offset_value": lambda: leading_real(F.col("sensor_offset")), "sample_rate_hz": lambda: leading_int(F.col("sample_rate")), "file_size": lambda: F.col("file_size").try_cast("int")},
    ),
]


def _prop(name: str):
    return F.element_at("props", F.lit(name))


def _participations(g: Graph) -> DataFrame:
    """An official result needs an event, a horse and a rider."""
    p = g.match("participation_id", "EventParticipation").into("participation_id", "HASPARTICIPATION", "event_id").out("participation_id", "HASHORSE", "horse_id", "Horse").out("participation_id", "HASRIDER", "rider_id", "Rider")
    named = g.props(p.table(), "participation_id", "EventParticipation", rank="rank", status="status")
    return named.select("participation_id", "event_id", "horse_id", "rider_id", F.col("rank").try_cast("int").alias("rank"), "status")


def tables_of(g: Graph) -> dict[str, DataFrame]:
    """All 14 tables by name."""
    out = {s.name: project_table(g, s) for s in SPECS}
    positions = g.label(GENERIC_SENSOR).select(F.col("id").alias("sensor_id"), first_other(F.col("labels"), GENERIC_SENSOR).alias("sensor_type"))
    out["sensors"] = out["sensors"].join(positions, "sensor_id")
    for role, name in zip(ROLES, ("riders", "veterinarians", "caretakers"), strict=True):
        out[name] = out["people"].where(F.col("role") == role).select("person_id")
    out["event_entries"] = project_relation(g, "COMPETESIN", "horse_id", "event_id", ("Horse",))
    out["horse_rider_associations"] = project_relation(g, "ASSOCIATEDWITH", "rider_id", "horse_id", ("Rider",), ("Horse",))
    actors = project_relation(g, "INVOLVESACTOR", "training_id", "actor_id")
    out["training_actors"] = actors.join(out["people"].select(F.col("person_id").alias("actor_id"), F.col("role").alias("actor_role")), "actor_id").select("training_id", "actor_id", "actor_role")
    out["event_participations"] = _participations(g)
    return {name: out[name] for name in KEYS}


def derive_again(g: Graph) -> dict[str, DataFrame]:
    """The tables that rest on links, from patterns alone."""
    labelled = lambda var, *labels: g.label(*labels).select(F.col("id").alias(var), first_of(F.col("labels"), list(labels)).alias("__label"))
    events = g.match("event_id", *DISCIPLINES).out("event_id", "INSEASON", "season_id", "CompetitiveSeason").table().join(labelled("event_id", *DISCIPLINES), "event_id")
    events = g.props(events, "event_id", *DISCIPLINES, location="eventLocation", category="category", event_date="eventDate").withColumnRenamed("__label", "discipline")
    base = g.match("horse_id", "Horse").out("horse_id", "TRAINSIN", "training_id", *STAGES)
    trainings = base.optional(g.match("training_id", *STAGES).out("training_id", "DEPENDSON", "event_id")).table().join(labelled("training_id", *STAGES), "training_id")
    trainings = g.props(trainings, "training_id", *STAGES, volume="Volume", intensity="Intensity", frequency="Frequency").withColumnRenamed("__label", "stage_type")
    actors = g.match("training_id", *STAGES).out("training_id", "INVOLVESACTOR", "actor_id", *ROLES).table().join(labelled("actor_id", *ROLES), "actor_id").withColumnRenamed("__label", "actor_role")
    sensors = g.match("sensor_id", GENERIC_SENSOR).out("sensor_id", "ISATTACHEDTO", "horse_id", "Horse").optional(g.match("sensor_id", GENERIC_SENSOR).out("sensor_id", "ISUSEDFOR", "objective_id", "ExperimentalObjective"))
    entries = g.match("horse_id", "Horse").out("horse_id", "COMPETESIN", "event_id")
    return {"events": events, "trainings": trainings, "training_actors": actors, "sensors": sensors.table(), "event_entries": entries.table(), "event_participations": _participations(g)}
