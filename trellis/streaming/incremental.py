"""Incremental work: skip what is done, append in micro-batches, keep the latest by key.

The batch forms are joins; the streaming forms use Structured Streaming's
checkpoints, watermarks and foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellis.operators.retrieval import latest


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of todo whose key is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of windows; rows that come later than ``late`` are dropped."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def first_seen(stream: DataFrame, ts: str, late: str, key) -> DataFrame:
    """Rows whose key was not seen within the watermark (a feed polled again and again)."""
    return stream.withColumn("__key", key).withWatermark(ts, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


#: Buckets of a key, and versions of the table that stay for its readers.
BUCKETS, VERSIONS = 64, 2
_BUCKET, _VERSION = "upsert_bucket", "upsert_version"


def _folder(path: str, bucket: int | str, version: int | str) -> str:
    return f"{path}/{_BUCKET}={bucket}/{_VERSION}={version}"


def upsert_into(spark: SparkSession, stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest row of each key in a Parquet table, in buckets of the key. A micro-batch reads and
    writes only the buckets that it touches, each as a new version beside the old one, so a batch that is
    run again gives the same table; older versions than the last VERSIONS of a bucket are deleted."""

    def step(batch: DataFrame, number: int) -> None:
        session, place = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch = batch.withColumn("__bucket", place).persist()
        touched = [r[0] for r in batch.select("__bucket").distinct().collect()]  # ``buckets`` numbers at most
        versions = _versions(session, path)
        old = [_folder(path, b, max(v)) for b in touched if (v := [x for x in versions.get(b, []) if x < number])]
        rows = batch.drop("__bucket")
        if old:
            rows = rows.unionByName(session.read.schema(rows.schema).parquet(*old))
        new = latest(rows, key, [F.desc(order)]).withColumns({_BUCKET: place, _VERSION: F.lit(number)})
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET, _VERSION).parquet(path)
        batch.unpersist()
        for b in touched:
            for v in sorted({*versions.get(b, []), number})[:-VERSIONS]:
                _files(session, path).delete(_path(session, _folder(path, b, v)), True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Versions of each bucket of a table; BUCKETS * VERSIONS folders or little more."""
    found: dict[int, list[int]] = {}
    for status in _files(spark, path).globStatus(_path(spark, _folder(path, "*", "*"))) or []:
        where = status.getPath()
        found.setdefault(int(where.getParent().getName().split("=")[1]), []).append(int(where.getName().split("=")[1]))
    return found


def read_upserted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as the last version of each bucket has it."""
    last = [_folder(path, b, max(v)) for b, v in _versions(spark, path).items()]
    return spark.read.schema(schema).parquet(*last) if last else spark.createDataFrame([], schema)


def append_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Partial saves: what is there is processed and appended; the next start resumes after it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
