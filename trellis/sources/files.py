"""Sources and sinks of files: text corpora, JSON questions, conversations, exports, feeds."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "test_questions array<struct<question_id:string,question:string,ground_truth:string,category:string,difficulty:string>>"
CONVERSATION = "id string, title string, messages array<struct<role:string,content:string>>, created_at string, updated_at string"
ARTICLE = "source string, title string, link string, published string, summary string, date timestamp"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file stem), text, entity_type (folder, singular), filename; blank files are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    folder = F.regexp_extract(where, r"([^/]+)/[^/]+$", 1)
    return files.select(
        F.regexp_extract(where, r"([^/]+)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"),
        F.regexp_replace(folder, "s$", "").alias("entity_type"), F.regexp_extract(where, r"([^/]+)$", 1).alias("filename"),
    ).where(F.col("text").rlike(r"\S"))


def read_questions(spark: SparkSession, path: str, only: list[str] | None = None, start: str | None = None, limit: int | None = None) -> DataFrame:
    """Questions of a benchmark file with their ordinal. ``only`` overrides the others; an unknown id is an error."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    rows = spark.read.schema(QUESTIONS).json(path, multiLine=True).select(F.posexplode("test_questions").alias("ordinal", "q")).select("ordinal", "q.*")
    for wanted in [*(only or []), *([start] if start else [])]:
        if rows.where(F.col("question_id") == wanted).isEmpty():
            raise ValueError(f"unknown question {wanted}")
    if only:
        return rows.where(F.col("question_id").isin(only))
    if start:
        first = rows.where(F.col("question_id") == start).agg(F.min("ordinal").alias("__first"))
        rows = rows.join(F.broadcast(first), F.col("ordinal") >= F.col("__first")).drop("__first")
    return rows if limit is None else rows.orderBy("ordinal").limit(limit)


def upsert_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Old rows whose key is not in new, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations, the latest first; a missing update time counts as the earliest."""
    return spark.read.schema(CONVERSATION).json(path).orderBy(F.coalesce("updated_at", F.lit("")).desc(), "id")


def save_conversation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id; the creation time of what was there is kept."""
    made = old.select("id", F.col("created_at").alias("__made"))
    fresh = new.join(made, "id", "left").withColumn("created_at", F.coalesce("__made", "created_at")).drop("__made")
    return upsert_documents(old, fresh.select(*old.columns), "id")


def schema_report(df: DataFrame, samples: int = 3) -> DataFrame:
    """field, type and the ``samples`` least distinct values of text columns (null for others), from one pass:
    each task keeps so many values of a field before the shuffle."""
    from pyspark.sql import Window

    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("field"), F.lit(k).alias("type"), F.col(f"`{n}`").alias("value") if k == "string" else F.lit(None).cast("string").alias("value")) for i, (n, k) in enumerate(df.dtypes)])
    values = df.select(F.inline(cells)).distinct()
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("at", "field", "type").orderBy(F.col("value").asc_nulls_last()))).where(F.col("rank") <= samples)
    listed = F.sort_array(F.collect_list("value"))
    return ranked.groupBy("at", "field", "type").agg(listed.alias("samples")).select("field", "type", F.when(F.col("type") == "string", F.col("samples")).alias("samples"))


def describe_schema(df: DataFrame, samples: int = 3) -> dict[str, tuple[str, list[str]]]:
    """The report as column -> (type, samples)."""
    found = {r["field"]: (r["type"], r["samples"] or []) for r in schema_report(df, samples).collect()}  # a row a column
    return {name: found.get(name, (kind, [])) for name, kind in df.dtypes}


def new_conversation(spark: SparkSession, title: str = "", now: str | None = None) -> DataFrame:
    """One empty conversation with an id of its own."""
    made = now or time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
    return spark.createDataFrame([(uuid.uuid4().hex, title, [], made, made)], CONVERSATION)


def delete_conversations(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("id").distinct(), "id", "left_anti")
