"""Comparing result sets, and metrics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_token(column: Column, kind: T.DataType, as_set: bool) -> Column:
    """Canonical text of a cell: null, true or false, whole numbers without a fraction, lists as
    sorted multisets (or sets), structs and maps as sorted key:value pairs."""
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "true").otherwise("false")
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = column.cast("double") == F.floor(column.cast("double"))
        text = F.when(whole & (F.abs(column.cast("double")) < 1e15), column.cast("double").try_cast("long").cast("string")).otherwise(column.cast("string"))
    elif isinstance(kind, T.ArrayType):
        values = F.transform(column, lambda x: cell_token(x, kind.elementType, as_set))
        text = F.concat(F.lit("["), F.array_join(F.sort_array(F.array_distinct(values) if as_set else values), "|"), F.lit("]"))
    elif isinstance(kind, T.StructType):
        pairs = F.sort_array(F.array(*[F.concat(F.lit(f"{f.name}:"), cell_token(column[f.name], f.dataType, as_set)) for f in kind]))
        text = F.concat(F.lit("{"), F.array_join(pairs, "|"), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), cell_token(e["value"], kind.valueType, as_set)))
        text = F.concat(F.lit("{"), F.array_join(F.sort_array(pairs), "|"), F.lit("}"))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("null"))


def ordered_tokens(df: DataFrame) -> DataFrame:
    """token: a row's cells in column order with their types told apart (1 is not 1.0)."""
    cells = [F.coalesce(F.concat(F.lit(f"{f.dataType.simpleString()}="), F.col(f"`{f.name}`").cast("string")), F.lit("None")) for f in df.schema]
    return df.select(F.concat_ws("\x01", *cells).alias("token"))


def unordered_tokens(df: DataFrame, as_set: bool = False) -> DataFrame:
    """token: the sorted multiset of a row's cell tokens; names and order of columns do not matter."""
    cells = F.array(*[cell_token(F.col(f"`{f.name}`"), f.dataType, as_set) for f in df.schema])
    return df.select(F.array_join(F.sort_array(cells), "\x01").alias("token"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """token, n_left, n_right where the numbers differ: empty iff the two are equal as multisets.
    One aggregate of the union; neither side is collected."""
    both = left.select("token", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select("token", F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy("token").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).where("n_left <> n_right")


def same_result(gold: DataFrame, found: DataFrame, columns_matter: bool = False, as_set: bool = False) -> bool:
    if columns_matter:
        if len(gold.columns) != len(found.columns):
            return False
        return multiset_difference(ordered_tokens(gold), ordered_tokens(found)).isEmpty()
    return multiset_difference(unordered_tokens(gold, as_set), unordered_tokens(found, as_set)).isEmpty()


def rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def average_without_nan(value: Column) -> Column:
    return F.avg(F.nanvl(value, F.lit(None).cast("double")))


def mean_or_zero(value: Column) -> Column:
    """An average that is 0.0 where there is nothing to average."""
    return F.coalesce(average_without_nan(value.cast("double")), F.lit(0.0))


def canonical(column: Column, kind: T.DataType) -> Column:
    """The same value with fields of structs in order of name and entries of maps in order of key, at any depth; lists keep their order."""
    if isinstance(kind, T.StructType):
        fields = [canonical(column[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(entries, by_key))
    return column


def canonical_json(df: DataFrame) -> Column:
    """A row of df as JSON in canonical order, compiled from its schema; null fields are left out, null entries of maps and lists stay."""
    return F.to_json(F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)]), {"ignoreNullFields": "true"})


def bucket(score: Column) -> Column:
    """perfect, high, mid, low, zero or nan."""
    return (
        F.when(score.isNull() | F.isnan(score), "nan").when(F.abs(score - 1) < 1e-9, "perfect").when(score >= 0.75, "high")
        .when(score >= 0.25, "mid").when(score >= 0.01, "low").otherwise("zero")
    )


def execution_stats(match: Column, applicable: Column) -> list[Column]:
    """Aggregates: applicable, matched, mismatched, not applicable, rate (null without any)."""
    n = F.count_if(applicable & match.isNotNull())
    ok = F.count_if(applicable & match)
    return [n.alias("n_applicable"), ok.alias("n_match"), F.count_if(applicable & ~match).alias("n_mismatch"), F.count_if(~applicable | match.isNull()).alias("n_na"), F.try_divide(ok.cast("double"), n.cast("double")).alias("match_rate")]


def retry_stats(attempts: Column, success: Column) -> list[Column]:
    tried, won = F.count_if(attempts > 1), F.count_if((attempts > 1) & success)
    return [tried.alias("n_retried"), won.alias("n_recovered"), F.try_divide(won.cast("double"), tried.cast("double")).alias("recovery_rate")]


def stats_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and count by each single key and over all, in one grouping-sets pass."""
    sets = ", ".join(f"({k})" for k in keys) + ", ()"
    named = ", ".join(f"cast({k} AS STRING) AS {k}" for k in keys)
    return df.sparkSession.sql(f"SELECT {named}, count(*) AS n, round(avg({value}), 6) AS mean_value FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=df)
