"""Checks of tables: orphans, duplicate keys, completeness, expected counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.shapes import orphans


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def orphan_report(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """link ('child.key') and the number of orphans, for each (child, key, parent, parent key)."""
    return _union([orphans(tables[c], [f], tables[p], [k]).agg(F.lit(f"{c}.{f}").alias("link"), F.count("*").alias("orphans")) for c, f, p, k in links])


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n, filled, from one pass over the table."""
    row = df.agg(F.count("*").alias("n"), *[F.count(f).alias(f"__{i}") for i, f in enumerate(fields)])
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col("n"), F.col(f"__{i}").alias("filled")) for i, f in enumerate(fields)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def expected_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """name, expected, found, fresh."""
    return _union([tables[n].agg(F.lit(n).alias("name"), F.lit(e).alias("expected"), F.count("*").alias("found"), (F.count("*") == e).alias("fresh")) for n, e in expected.items()])


def type_report(df: DataFrame) -> DataFrame:
    """field and type, as Spark names it."""
    return df.sparkSession.createDataFrame(df.dtypes, "field string, type string")


def null_share(df: DataFrame, field: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(field).isNull(), 1.0).otherwise(0.0)).alias("null_share"))
