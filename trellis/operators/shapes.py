"""Relational shapes above single aggregates: histograms of counts, pivots, percentages, diffs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram_of_counts(df: DataFrame, key: str, counted: str | None = None) -> DataFrame:
    """size (rows, or distinct ``counted``, of a key) and n_keys with that size."""
    size = F.count_distinct(counted) if counted else F.count("*")
    return df.groupBy(key).agg(size.alias("size")).groupBy("size").agg(F.count("*").alias("n_keys"))


def pct_of_total(df: DataFrame, key: str, decimals: int = 6) -> DataFrame:
    """key, n and pct of all rows. The total is one row."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("__total"))
    return n.crossJoin(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("__total"), decimals).alias("pct"))


def pivot_sum(df: DataFrame, row: str, column: str, values: list[str], value: Column) -> DataFrame:
    """One column for each value, sums with 0 where there is none. The values are given, so nothing is collected."""
    return df.groupBy(row).pivot(column, values).agg(F.sum(value)).na.fill(0)


def map_values(column: Column, mapping: dict[str, str]) -> Column:
    """The mapped value; values that the mapping lacks stay as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(pairs, column), column)


def in_order(column: Column, order: list[str]) -> Column:
    """Place of a categorical value in the given order; 0 if it is unknown."""
    return F.array_position(F.array(*map(F.lit, order)), column)


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full diff of two tables: keys, kind (missing_right, missing_left or mismatch), field,
    and both values as text. One full outer join; equal rows give nothing."""
    a = left.select(*keys, F.lit(True).alias("__l"), *[F.col(f).alias(f"__l_{f}") for f in fields])
    b = right.select(*keys, F.lit(True).alias("__r"), *[F.col(f).alias(f"__r_{f}") for f in fields])
    both = a.join(b, keys, "full_outer")
    absent = F.when(F.col("__r").isNull(), "missing_right").when(F.col("__l").isNull(), "missing_left")
    differs = [~F.col(f"__l_{f}").eqNullSafe(F.col(f"__r_{f}")) for f in fields]
    both = both.where(reduce(or_, differs, absent.isNotNull()))
    entry = lambda kind, field, l, r: F.struct(kind.alias("kind"), F.lit(field).cast("string").alias("field"), l.cast("string").alias("left_value"), r.cast("string").alias("right_value"))
    null = F.lit(None)
    per_field = F.array(*[F.when(d, entry(F.lit("mismatch"), f, F.col(f"__l_{f}"), F.col(f"__r_{f}"))) for f, d in zip(fields, differs, strict=True)])
    whole = F.array(entry(absent, None, null, null))
    rows = F.when(absent.isNotNull(), whole).otherwise(F.filter(per_field, lambda x: x.isNotNull())) if fields else whole
    return both.select(*keys, F.explode(rows).alias("d")).select(*keys, "d.*")


def orphans(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str]) -> DataFrame:
    """Rows of the child whose key is set and not in the parent (left anti join)."""
    named = parent.select(*[F.col(p).alias(f"__p_{p}") for p in pk])
    set_ = reduce(lambda x, y: x & y, [F.col(f).isNotNull() for f in fk])
    return child.where(set_).join(named, [F.col(f) == F.col(f"__p_{p}") for f, p in zip(fk, pk, strict=True)], "left_anti")


def duplicate_keys(df: DataFrame, pk: list[str]) -> DataFrame:
    return df.groupBy(*pk).agg(F.count("*").alias("n")).where("n > 1")


def semi_having(df: DataFrame, keys: list[str], having: Column) -> DataFrame:
    """Rows whose key tuple is among the groups that pass ``having``."""
    return df.join(df.groupBy(*keys).agg(having.alias("__keep")).where("__keep").select(*keys), keys, "left_semi")


def left_counts(base: DataFrame, key: str, **branches: DataFrame) -> DataFrame:
    """base with one count for each branch (key, member): distinct members of the key, 0 if none.

    Every branch is aggregated before the join, so several optional patterns never
    multiply each other's rows, and no correlated subquery is needed."""
    for name, branch in branches.items():
        k, member = branch.columns
        counted = branch.groupBy(F.col(k).alias(key)).agg(F.count_distinct(member).alias(name))
        base = base.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return base


def single_row(**counts: DataFrame) -> DataFrame:
    """One row of one-row aggregates (each with one column), joined by cross joins of single rows."""
    frames = [df.select(F.col(df.columns[0]).cast("long").alias(name)) for name, df in counts.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def with_fallback(*stages: DataFrame) -> DataFrame:
    """The rows of the first stage that has any: unioned with a priority, of which the least is kept."""
    tagged = reduce(lambda a, b: a.unionByName(b), [s.withColumn("__p", F.lit(i)) for i, s in enumerate(stages)])
    best = tagged.agg(F.min("__p").alias("__best"))
    return tagged.join(F.broadcast(best), F.col("__p") == F.col("__best"), "left_semi").drop("__p")
