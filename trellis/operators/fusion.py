"""Reconciling the answers of independent pipelines by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weights of an evidence score, and the order of pipelines in a tie.
WEIGHTS = {"groundedness": 0.40, "completeness": 0.25, "relevance": 0.20, "execution_quality": 0.15}
PIPELINES = ("graph", "tabular_v2", "textual")
TOLERANCE = 1e-4


def execution_quality(attempts: Column) -> Column:
    return F.when(attempts > 1, 0.9).otherwise(1.0)


def evidence_score(groundedness: Column, completeness: Column, relevance: Column, quality: Column) -> Column:
    """Null if any judged dimension is null."""
    return WEIGHTS["groundedness"] * groundedness + WEIGHTS["completeness"] * completeness + WEIGHTS["relevance"] * relevance + WEIGHTS["execution_quality"] * quality


def combined_score(semantic: Column, judged: Column) -> Column:
    return (semantic + judged) / 2


def agreement_groups(pairs: DataFrame) -> DataFrame:
    """Candidates and rule of each question.

    pairs: question_id, valid_graph, valid_tabular_v2, valid_textual (boolean), and for the
    pairs gt, gx and tx whether they were computed (c_*) and agree (a_*; null: judge error).
    Returns question_id, in_graph, in_tabular_v2, in_textual, strength, independence, rule."""
    valid = {p: F.coalesce(F.col(f"valid_{p}"), F.lit(False)) for p in PIPELINES}
    ends = {"gt": ("graph", "tabular_v2"), "gx": ("graph", "textual"), "tx": ("tabular_v2", "textual")}
    done = {k: F.coalesce(F.col(f"c_{k}"), F.lit(False)) & valid[a] & valid[b] for k, (a, b) in ends.items()}
    yes = {k: done[k] & F.coalesce(F.col(f"a_{k}"), F.lit(False)) for k in ends}
    number = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    v, computed, agreed = number(valid.values()), number(done.values()), number(yes.values())
    textual = yes["gx"] | yes["tx"]
    in_pairs = {p: F.lit(False) for p in PIPELINES}
    for k, (a, b) in ends.items():
        in_pairs[a], in_pairs[b] = in_pairs[a] | yes[k], in_pairs[b] | yes[k]
    rule = (
        F.when(v == 0, "all_pipelines_failed").when(v == 1, "only_one_valid").when(computed == 0, "not_applicable")
        .when((v == 2) & (agreed == 1), "single_pair_agreement_two_valid").when(v == 2, "no_agreement_two_valid")
        .when(agreed == 3, "all_three_agree").when((agreed == 2) & (computed == 3), "transitivity_conflict")
        .when(agreed >= 1, "single_pair_agreement").otherwise("no_agreement")
    )
    table = pairs.withColumn("rule", rule).withColumn("__textual", textual)
    pair_rules = F.col("rule").isin("single_pair_agreement", "single_pair_agreement_two_valid")
    strength = F.when(pair_rules, F.when(F.col("__textual"), "strong").otherwise("moderate")).when(F.col("rule") == "all_three_agree", "strongest").when(F.col("rule") == "transitivity_conflict", "conflict").otherwise("none")
    independence = F.when(pair_rules, F.when(F.col("__textual"), "more_independent_sources").otherwise("shared_upstream_source")).when(F.col("rule") == "all_three_agree", "all_sources_converge").when(F.col("rule") == "transitivity_conflict", "inconsistent").otherwise("none")
    members = [F.when(pair_rules, in_pairs[p]).otherwise(valid[p]).alias(f"in_{p}") for p in PIPELINES]
    return table.select("question_id", *members, strength.alias("strength"), independence.alias("independence"), "rule")


def pick_best(candidates: DataFrame) -> DataFrame:
    """One row for each question: the candidate with the best evidence score, ties (within the
    tolerance) broken by groundedness, completeness, relevance and the fixed order, one after another.
    A missing score counts as -1."""
    rows = candidates
    for dimension in ("evidence_score", "groundedness", "completeness", "relevance"):
        value = F.coalesce(F.nanvl(F.col(dimension).cast("double"), F.lit(-1.0)), F.lit(-1.0))
        best = F.max(value).over(Window.partitionBy("question_id"))
        rows = rows.withColumn("__gap", best - value).where(F.col("__gap") <= TOLERANCE).drop("__gap")
    place = F.array_position(F.array(*map(F.lit, PIPELINES)), F.col("pipeline"))
    w = Window.partitionBy("question_id").orderBy(place, "pipeline")
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def select_answers(live: DataFrame, evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """question_id, selected pipeline (null if all failed), rule, strength, independence.

    live: question_id, pipeline, success. evidence: question_id, pipeline and scores.
    pairs: question_id, c_gt, a_gt, c_gx, a_gx, c_tx, a_tx. Nothing here sees a ground truth."""
    valid = live.groupBy("question_id").pivot("pipeline", list(PIPELINES)).agg(F.max("success"))
    valid = valid.select("question_id", *[F.col(p).alias(f"valid_{p}") for p in PIPELINES])
    groups = agreement_groups(valid.join(pairs, "question_id", "left"))
    member = F.coalesce(*[F.when(F.col("pipeline") == p, F.col(f"in_{p}")) for p in PIPELINES])
    candidates = live.where("success").select("question_id", "pipeline").join(groups, "question_id").where(member)
    best = pick_best(candidates.join(evidence, ["question_id", "pipeline"], "left")).select("question_id", F.col("pipeline").alias("selected"))
    return groups.select("question_id", "rule", "strength", "independence").join(best, "question_id", "left")


def summary(selections: DataFrame) -> DataFrame:
    """Counts and shares by rule and selected pipeline."""
    n = selections.groupBy("rule", "selected").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("__t"))
    return n.crossJoin(F.broadcast(total)).select("rule", "selected", "n", F.round(F.col("n") / F.col("__t"), 6).alias("share"))


def run_report(live: DataFrame, pairs: DataFrame, chosen: DataFrame, pipelines: tuple[str, ...] = PIPELINES, decimals: int = 6) -> DataFrame:
    """One row about a run: success and mean evidence of each pipeline, agreement of the computed pairs,
    conflicts and mean time. live: question_id, pipeline, success, evidence_score. pairs: question_id, pair,
    agreement (null counts as none). chosen: question_id, rule, seconds."""
    won = live.groupBy("question_id").agg(F.coalesce(F.max(F.col("success").cast("int")), F.lit(0)).alias("any"), *[F.max(F.when(F.col("pipeline") == p, F.coalesce(F.col("success"), F.lit(False)).cast("int"))).alias(p) for p in pipelines])
    rates = won.agg(F.count("*").alias("questions"), F.count_if(F.col("any") == 0).alias("all_failed"), *[F.round(F.avg(F.coalesce(p, F.lit(0)).cast("double")), decimals).alias(f"success_{p}") for p in pipelines])
    means = live.agg(*[F.round(F.avg(F.when(F.col("pipeline") == p, F.col("evidence_score"))), decimals).alias(f"evidence_{p}") for p in pipelines])
    agreed = F.count_if(F.coalesce("agreement", F.lit(False)))
    agreement = pairs.agg(F.count("*").alias("pairs_computed"), agreed.alias("pairs_agreed"), F.round(F.try_divide(agreed.cast("double"), F.count("*").cast("double")), decimals).alias("agreement_rate"))
    time = chosen.agg(F.round(F.avg("seconds"), decimals).alias("seconds"), F.count_if(F.col("rule") == "transitivity_conflict").alias("conflicts"))
    return rates.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(agreement)).crossJoin(F.broadcast(time))  # single rows
