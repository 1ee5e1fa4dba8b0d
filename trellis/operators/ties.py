"""Superlatives with all ties, leaderboards, ordered dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax_all(df: DataFrame, value: str, keys: list[str] | None = None, least: bool = False) -> DataFrame:
    """All rows whose value is the extreme of the table, or of each group of ``keys``.

    The extreme is an aggregate joined back (one row, or one a group), never a
    window over the whole table, so no task gets all rows. Null values never win."""
    pick = (F.min if least else F.max)(value).alias("__extreme")
    best = df.groupBy(*(keys or [])).agg(pick)
    if not keys:
        return df.join(F.broadcast(best), F.col(value) == F.col("__extreme"), "left_semi")  # one row
    best = best.select(*[F.col(k).alias(f"__{k}") for k in keys], "__extreme")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(value) == F.col("__extreme")]
    return df.join(best, on, "left_semi")


def leaderboard(df: DataFrame, value: str, tie_break: list[str], n: int, ascending: bool = False) -> DataFrame:
    """The first n rows by value with a full tie break (TakeOrderedAndProject)."""
    first = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return df.orderBy(first, *tie_break).limit(n)


def first_and_last(df: DataFrame, value: str) -> DataFrame:
    """All rows at the least or the greatest value."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.join(F.broadcast(ends), F.col(value).isin(F.col("__lo"), F.col("__hi")), "left_semi")  # one row


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def nan_last(value: Column) -> Column:
    """NaN as the least value instead of the greatest."""
    return F.nanvl(value, F.lit(float("-inf")))


def natural_order(column: Column) -> list[Column]:
    """Keys for ids such as Q2 < Q10: the letters, then the number, then the text."""
    return [F.regexp_extract(column, r"^(\D*)", 1), F.regexp_extract(column, r"(\d+)", 1).try_cast("long"), column]
