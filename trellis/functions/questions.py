"""Gates over questions and generated statements, as columns: word cues, no model.

Questions are French, as the corpus is; the lists below are part of the model's definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import contains_any, literals_in, normalise_question

# The cue lists of the gates, in the order in which they are documented.
COMPARATIVE = [
    "comparer", "compare", "comparaison", "comparison", "en comparaison", "différence", "differences", "difference", "différences", "différent de", "différente de",
    "différents de", "différentes de", "versus", " vs ", " vs.", "par rapport à", "par rapport aux", "contrairement à", "contrairement aux", "à la différence", "au contraire de",
]
COMPARATIVE_PATTERN = r"\b(?:plus|moins)\b.{0,40}\bque\b"
VERIFICATION = [
    "calibr", "cohérent", "coherent", "vérifi", "verifi", "sans résultat", "aucun résultat", "pas de résultat", "résultat officiel", "sortent du schéma", "hors schéma",
    "identifiants d'entraînement", "montés par plusieurs", "monte par plusieurs", "plusieurs cavaliers différents", "même nombre de compétitions", "participent-ils au même",
    "engagé dans une compétition sans", "engagés mais", "engagé mais", "ressemble-t-il", "correspond-il toujours", "correspond-elle toujours",
]
AGGREGATION = [
    "combien", "répart", "repart", "distribution", "la plus courante", "le plus courant", "les plus courants", "représentées par un seul", "representees par un seul", "quel nombre", "nombre de",
    "y a-t-il des races", "y a-t-il des chevaux",
]
HORSE = [
    "race de cheval", "races", "capteur", "capteurs", "imu", "échantillonnage", "echantillonnage", "entraînement", "entrainement", "préparation", "preparation", "pré-compétition", "pre-competition",
    "récupération", "recuperation", "transition", "séance", "seance", "volume", "intensité", "intensite", "programme d'entraînement", "programme d'entrainement", "soigneur", "vétérinaire", "veterinaire",
    "cavaliers différents", "cavaliers differents", "associés", "associes",
]
EVENT = [
    "événement sportif", "evenement sportif", "événements sportifs", "evenements sportifs", "compétition", "competition", "compétitions", "competitions", "classement", "catégorie", "categorie",
    "résultat officiel", "resultat officiel", "engagé", "engage", "engagés", "engages", "saison 2026", "période de la saison", "periode de la saison", "discipline", "lieu", "saumur", "nantes", "bordeaux",
]
EVENT_FIRST = [
    "combien d'événements", "combien d'evenements", "événements sportifs sont enregistrés", "evenements sportifs sont enregistres", "sans résultat officiel", "sans resultat officiel",
    "chevaux engagés", "chevaux engages",
]
HORSE_FIRST = [
    "race de cheval la plus courante", "races rares", "durée des séances", "duree des seances", "phase de récupération", "phase de recuperation", "phase de préparation", "phase de preparation",
    "pré-compétition les plus", "préparation les plus", "capteurs imu", "montés par plusieurs cavaliers", "montes par plusieurs cavaliers",
]
TAXONOMY = [
    "Amateur 1", "Amateur 2", "Club Elite", "Pro Elite", "ShowJumping", "Dressage", "Cross", "saut d'obstacles", "cross / concours complet", "dressage", "concours complet",
    "Élevée", "Modérée", "Faible", "Pic", "Withers", "Sternum", "CanonOfForelimb", "CanonOfHindlimb", "garrot", "sternum", "canon antérieur", "canon postérieur",
    "PreparationStage", "PreCompetitionStage", "CompetitionStage", "TransitionStage",
]
COUNTING = [
    "combien", "répart", "comparer", "comparaison", "plus fréquent", "plus courant", "plus courante", "moyenne", "en moyenne", "varie", "varient", "durée des séances",
    "fréquence d'entraînement", "fréquence d’entraînement",
]
AGGREGATES = ["count(", "sum(", "avg(", "max(", "min(", "group by"]
DISTRIBUTION = ["durée des séances", "fréquence d'entraînement", "fréquence d’entraînement", "répart", "varie", "varient"]
SUPERLATIVES = ["le plus", "la plus", "les plus", "le moins", "la moins", "plus grand nombre", "plus de résultats", "plus longues", "les plus longues"]
FORBIDDEN = ["CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "LOAD CSV", "FOREACH", "CALL", "USE"]
UNSUPPORTED = ["HAVING", "GROUP BY"]


def is_comparative(question: Column) -> Column:
    q = normalise_question(F.coalesce(question, F.lit("")))
    return contains_any(q, COMPARATIVE) | q.rlike(COMPARATIVE_PATTERN)


def is_verification(question: Column) -> Column:
    return contains_any(normalise_question(F.coalesce(question, F.lit(""))), VERIFICATION)


def is_aggregation(question: Column) -> Column:
    return contains_any(normalise_question(F.coalesce(question, F.lit(""))), AGGREGATION)


def preferred_type(question: Column) -> Column:
    """'event' or 'horse' where the question is about one of them, else null; the strong cues decide first."""
    q = normalise_question(F.coalesce(question, F.lit("")))
    horse, event = contains_any(q, HORSE), contains_any(q, EVENT)
    return F.when(contains_any(q, EVENT_FIRST), "event").when(contains_any(q, HORSE_FIRST), "horse").when(horse & ~event, "horse").when(event & ~horse, "event")


def taxonomy_values(question: Column) -> Column:
    """The known values that the question names, whatever their case, the longest first."""
    return literals_in(F.coalesce(question, F.lit("")), sorted(TAXONOMY, key=len, reverse=True))


def aggregate_complaint(question: Column, sql: Column) -> Column:
    """Null if the statement may pass: a counting question needs an aggregate, a distribution more than a bare GROUP BY."""
    q, s = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.coalesce(sql, F.lit("")))
    asks, has, counts = contains_any(q, COUNTING), contains_any(s, AGGREGATES), contains_any(s, AGGREGATES[:-1])
    return F.when(asks & has & ~counts & contains_any(q, DISTRIBUTION), "a distribution needs an aggregate beside GROUP BY").when(asks & ~has, "the question counts, the statement does not")


def tie_complaint(question: Column, sql: Column) -> Column:
    """Null if the statement may pass: LIMIT 1 loses the ties of a superlative, and of sensor loads."""
    q, s = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.replace(F.coalesce(sql, F.lit("")), F.lit("\n"), F.lit(" ")))
    herd = q.contains("capteur") & contains_any(q, ["moins", "plus"]) & s.contains("sensor")
    return F.when(s.contains("limit 1") & herd, "show the whole histogram of sensors").when(s.contains("limit 1") & contains_any(q, SUPERLATIVES), "LIMIT 1 loses ties; compare with the extreme")


def pattern_complaint(statement: Column) -> Column:
    """A guard of graph statements by their text: null if it is one that only reads, else the reason."""
    text = F.trim(F.regexp_replace(F.coalesce(statement, F.lit("")), r"(?i)^\s*```(?:cypher)?\s*|\s*```\s*$", ""))
    upper = F.upper(text)
    named = lambda words: [F.when(upper.rlike(rf"\b{w}\b"), F.lit(w)) for w in words]
    return (
        F.when(text == "", "empty").when(F.regexp_replace(text, r";+$", "").contains(";"), "more than one statement")
        .when(F.coalesce(*named(FORBIDDEN)).isNotNull(), F.concat(F.lit("forbidden: "), F.coalesce(*named(FORBIDDEN))))
        .when(F.coalesce(*named(UNSUPPORTED)).isNotNull(), F.concat(F.lit("unsupported: "), F.coalesce(*named(UNSUPPORTED))))
        .when(~upper.contains("RETURN"), "nothing is returned")
    )
