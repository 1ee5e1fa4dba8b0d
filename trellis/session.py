"""Session builder and the table loader."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trellis", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, ANSI, UTC; every setting can be overridden through ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if "TRELLIS_SHUFFLE_PARTITIONS" in os.environ:
        settings["spark.sql.shuffle.partitions"] = os.environ["TRELLIS_SHUFFLE_PARTITIONS"]
    return builder.config(map=settings | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share (spark.checkpoint.dir); a temporary one
    where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="trellis-")
    return _LOCAL[application]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what follows neither computes it again nor needs
    the shuffle files of an executor that is lost. ``path`` of the result says where it is."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.path = path
    return found


def removed(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for table_ in tables:
        spark = table_.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table_.path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def children(spark: SparkSession, path: str) -> list[int]:
    """Numbers v of the folders path/v=N."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*")
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where) or []
    return sorted(int(f.getPath().getName()[2:]) for f in found)


def deleted(spark: SparkSession, *paths: str) -> None:
    """Delete folders in whatever file system holds them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
