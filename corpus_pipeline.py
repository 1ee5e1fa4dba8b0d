"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, other columns that docs has included, whatever their names.

Defined cases: a null or empty text fails the quality rules. Rows that repeat a
doc_id, or have none, are documents of their own: duplicates are the rows equal
in id and text (one stays), near duplicates are found by text, and stages remove
rows, never all rows of an id. Of near duplicates the least id stays (null is the
least). Repeated passages stay where they start first. An empty table gives an
empty result. Texts of any length are handled whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import chosen_path, decontam, quality, spm, substring
from trellis.llm.registry import documents, piece_model
from trellis.llm.shared import materialise, remove, scratch_dir, scratch_folder, sent_if_few, whole


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class of near duplicates."""
    return chosen_path.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier elsewhere; n_chars follows. Texts
    of which nothing is left go."""
    others = docs.drop("doc_id", "text", "n_chars")
    own = docs.select("doc_id", "text", *[whole(others).alias("others")] * bool(others.columns))  # whatever their names
    kept = substring.dedup(own, keep=("others",) * bool(others.columns))
    left = kept.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col("others").getField(c) for c in others.columns}
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, word for word or by proximity."""
    # rows that share a doc_id, or have none, are told apart by a hash of the text
    own = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("__row"), "text")
    found = decontam.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row")
    hit = found.where("n_hit > 0 or size(near_items) > 0").select(F.col("__row.id").alias("hit_id"), F.col("__row.h").alias("hit_h")).distinct()
    hit = sent_if_few(materialise(hit, "leaks"))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), whole(docs).alias("own"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left_anti").select("own.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian 32-bit integers) with their digests."""
    return spm.encode_digests(docs, piece_model(), with_ids=True).drop("n_differ")


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The last stage has no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder. A stage's scratch
    tables go when it has been written, and its input when nothing reads it any more."""
    docs = documents(spark, sf_dir)
    folder, before = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scratch_folder(spark, name):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
