"""Relational tables as Parquet folders and temporary views, and read-only queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.operators.guard import check_statement
from trellis.operators.shapes import duplicate_keys


def save_tables(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None) -> None:
    """Write every table anew; a table whose key has duplicates is an error, and nothing of it is written."""
    for name, df in tables.items():
        key = (keys or {}).get(name)
        if key and not duplicate_keys(df, key).isEmpty():
            raise ValueError(f"{name}: {key} is no key")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def open_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables, each also as a temporary view of its name."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def query(spark: SparkSession, sql: str, args: dict | None = None, limit: int | None = None) -> DataFrame:
    """A statement that only reads, over the views. No silent cut: a limit is given or there is none."""
    ok, reason = check_statement(spark, sql, args=args)
    if not ok:
        raise ValueError(reason)
    df = spark.sql(sql.strip().rstrip(";"), args=args or {})
    return df if limit is None else df.limit(limit)
