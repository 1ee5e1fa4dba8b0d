"""Scratch tables in the shared folder, Arrow batches cut to a size in bytes, memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import scratch_dir


def materialise(df: DataFrame, name: str, *partitioned: str) -> DataFrame:
    """Write df as Parquet in the shared folder (in folders by the columns ``partitioned``) and read it
    back: what follows neither recomputes it nor depends on a lost executor's shuffle files."""
    spark = df.sparkSession
    path = f"{_FOLDERS[-1] if _FOLDERS else scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.partitionBy(*partitioned).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


#: Folders of scratch_folder() that are open.
_FOLDERS: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.scratch_path)


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder in the shared folder, which holds the tables written meanwhile and goes at the
    end. A result that reads them must have been written elsewhere by then."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    try:
        yield path
    finally:
        _FOLDERS.remove(path)
        remove(spark, path)


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


#: Rows of keys (some tens of bytes each) that are sent to all tasks, at most.
SENT_ROWS = 500_000


def sent_if_few(keys: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be sent to all tasks if it has SENT_ROWS rows at most (they are
    counted); a larger one is joined by a shuffle. So texts stay where they are while the keys are few."""
    return F.broadcast(keys) if keys.count() <= SENT_ROWS else keys


#: Tables that a Python worker keeps between tasks: owner -> what empties them.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, empty: Callable[[], None]) -> None:
    """Register a table that stays between tasks of one operator."""
    _KEPT[owner] = empty


def give_back(owner: str = "") -> None:
    """At the end of a task: empty the tables of other operators, and return freed memory."""
    for name, empty in list(_KEPT.items()):
        if name != owner:
            empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def by_batches(df: DataFrame, run: Callable, schema, owner: str = "") -> DataFrame:
    """df.mapInArrow(run, schema), after which each worker gives its memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back(owner)

    return df.mapInArrow(whole, schema)


def by_groups(grouped, run: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """grouped.applyInArrow(run, schema), after each group of which the worker gives its memory back."""

    def whole(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return grouped.applyInArrow(whole, schema)


def tree_sum(rows: DataFrame, key: str, sums: dict[str, str], fan: int = 32) -> DataFrame:
    """Vectors (packed numbers, binary) of equal key added up: key and the columns of ``sums``
    (column -> numpy type, kept). Column ``part`` numbers the tasks that sent them. Groups of at
    most ``fan`` rows are added at a time, so no task holds a row of every task."""
    n = rows.agg(F.max("part")).first()[0]
    kind = rows.schema[key].dataType.simpleString()

    def add(table: pa.Table) -> pa.Table:
        out = {c: table.column(c).slice(0, 1) for c in (key, "part")}
        for c, number in sums.items():
            total = 0
            for x in table.column(c):
                total = total + np.frombuffer(x.as_buffer(), number)
            out[c] = pa.array([total.tobytes()], pa.binary())
        return pa.table(out)

    left = (n or 0) + 1
    rows = rows.select(key, "part", *sums)
    while left > 1:
        rows = rows.withColumn("part", F.floor(F.col("part") / fan)).groupBy(key, "part").applyInArrow(add, f"{key} {kind}, part long, " + ", ".join(f"{c} binary" for c in sums))
        left = -(-left // fan)
    return rows.drop("part")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it holds, Arrow batches have at most so many rows: texts vary so much in length that
    batches of the usual 10,000 rows take a large share of an executor's memory, twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Relative error of the counts of distinct texts that thresholds are made of.
COUNT_ERROR = 0.02


def hash_limit(k: int, distinct: int) -> int:
    """Of hashes below 1 << 30, the limit under which at least k of so many distinct texts fall
    (all, if there are no more), and not many more; the count may be off by five times COUNT_ERROR."""
    share = (k + 6 * k**0.5 + 20) / max(distinct * (1 - 5 * COUNT_ERROR), 1)
    return int(min(1.0, share) * (1 << 30))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each (one row
    at least), so that the arrays made of them stay small whatever the rows are."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and the n + 1 offsets. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
