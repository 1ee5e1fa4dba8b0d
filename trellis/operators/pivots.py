"""Exact nearest vectors from a table partitioned by pivots.

Every vector lies in the cell of its nearest pivot, with its distance from it. By the triangle
inequality no vector of a cell is nearer to a query than (distance to the pivot) - (radius of the
cell). A query first reads the nearest cells that hold k vectors together; the k-th distance found there
excludes cells before anything is compared. The result is that of comparing everything.

Cells are folders of the table, so those that no query needs are not read. Queries meet the vectors of a
cell by a shuffle, in squares of bounded size. Pivots (COUNT at most) and their cells' sizes and radii are
all that leaves the tasks or is sent to them. Where vectors are not clustered no cell can be excluded, and
the work is that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators.squares import QUERIES, SIDE, compared, matrix, usable
from trellis.session import removed, written

#: Pivots, at most.
COUNT = 256
#: Slack of bounds for rounding, relative to the distances.
_SLACK = 1e-5


@dataclass(frozen=True)
class PivotTable:
    """key, embedding, distance (from the pivot), by cell; the pivots; cell -> (n, least and greatest distance)."""

    rows: DataFrame
    pivots: np.ndarray
    cells: dict[int, tuple[int, float, float]]
    key: str
    vector: str
    decimals: int = 6


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots**2).sum(1)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                x = matrix(part.column(1))
                cell = ((x**2).sum(1)[:, None] + norms - 2 * x @ pivots.T).argmin(1)
                distance = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(distance), pa.array(cell.astype(np.int32))], [*part.schema.names, "distance", "cell"])

    return run


def choose_pivots(vectors: DataFrame, count: int, vector: str, key: str) -> np.ndarray:
    """``count`` vectors at most, spread out: from four times as many, by a hash of their key, the one farthest from those chosen is next."""
    some = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("h")).orderBy("h").limit(4 * count).select(vector).collect()
    x = np.array([r[0] for r in some], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def store(vectors: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id", count: int | None = None) -> PivotTable:
    """Write vectors (those that are null are left out) by cell, and say what the cells hold."""
    spark, rows = vectors.sparkSession, vectors.where(F.col(vector).isNotNull()).select(key, vector)
    if count is None:
        count = min(COUNT, max(1, int(rows.count() ** 0.5)))
    pivots = choose_pivots(rows, count, vector, key)
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, {vector} {rows.schema[vector].dataType.simpleString()}, distance double, cell int"
    placed = rows.mapInArrow(_nearest(pivots), kind) if len(pivots) else spark.createDataFrame([], kind)
    # a cell's vectors by distance, so that the row groups of its files are stretches of distances
    spread = F.pmod(F.xxhash64(key), F.lit(16))
    placed.repartition("cell", spread).sortWithinPartitions("cell", "distance").write.mode("overwrite").partitionBy("cell").parquet(path)
    table = spark.read.schema(kind).parquet(path)
    cells = {r["cell"]: (r["n"], r["low"], r["high"]) for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()}  # a row a pivot
    return PivotTable(table, pivots, cells, key, vector)


@dataclass
class Found:
    """query, key, distance (squared, rounded) and rank; and the share of (query, cell) pairs, and of cells, that were read."""

    rows: DataFrame
    pairs_read: float
    cells_read: float


def _asks(table: PivotTable, k: int, query: str, first: bool):
    """Rows (query, q, cell, bound) of a batch of queries: the nearest cells that hold k vectors together, or
    the others that may hold vectors within ``far``, the k-th distance found in the nearest."""
    cell_ids = np.array(sorted(table.cells), np.int32)
    sizes, low, high = (np.array([table.cells[int(c)][i] for c in cell_ids]) for i in range(3))
    pivots, margin = table.pivots[cell_ids], 10.0**-table.decimals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                x = matrix(part.column(1))
                at = np.sqrt(np.maximum(0, np.stack([((pivots - v) ** 2).sum(1) for v in x])))
                order = np.argsort(at, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                chosen = np.zeros(at.shape, bool)
                np.put_along_axis(chosen, order, before < k, axis=1)
                bound = np.full(len(x), np.inf)
                if not first:
                    far = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    bound = np.where(np.isnan(far), np.inf, np.sqrt(far + margin)) * (1 + _SLACK) + _SLACK
                    least = np.maximum(0, np.maximum(at - high, low - at))  # nothing of a cell is nearer
                    chosen = (least <= bound[:, None]) & ~chosen
                row, column = np.nonzero(chosen)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cell_ids[column]), pa.array(bound[row] ** 2)], [query, "q", "cell", "bound"])

    return run


def _compared(table: PivotTable, asked: DataFrame, counts: dict[int, int], k: int, query: str, block: int) -> DataFrame:
    """query, key, distance: the k nearest within the bound in each square of a cell's vectors and the queries that ask for it."""
    spark = asked.sparkSession
    dealt = lambda count, *by: F.pmod(F.xxhash64(*by), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    cuts = spark.createDataFrame([(c, -(-table.cells[c][0] // SIDE), -(-n // block)) for c, n in counts.items()], "cell int, across int, down int")  # a row a pivot
    rows = table.rows.where(F.col("cell").isin(sorted(counts))).join(F.broadcast(cuts), "cell")
    left = rows.select(table.key, table.vector, "cell", dealt("across", table.key, table.vector).alias("__x"), every("down").alias("__y"))
    right = asked.join(F.broadcast(cuts), "cell").select(query, "q", "bound", "cell", dealt("down", query, "q").alias("__y"), every("across").alias("__x"))
    return compared(left, right, ["cell", "__x", "__y"], k, table.decimals, table.key, table.vector, query, "q", "bound")


def nearest(table: PivotTable, queries: DataFrame, k: int, query: str = "query_id", decimals: int = 6, block: int = QUERIES) -> Found:
    """The k nearest of each of a stated set of queries (squared distance, rounded; ties by key): exact. Two rounds,
    whatever the number of queries: a cell's vectors are compared with ``block`` queries at a time, in squares that are dealt to tasks."""
    spark, kind = queries.sparkSession, queries.schema[query].dataType.simpleString()
    key_kind = table.rows.schema[table.key].dataType.simpleString()
    if not table.cells:
        return Found(spark.createDataFrame([], f"{query} {kind}, {table.key} {key_kind}, distance double, rank int"), 0.0, 0.0)
    table = replace(table, decimals=decimals)
    own = queries.where(usable(F.col(table.vector), table.pivots.shape[1])).select(query, F.col(table.vector).alias("q"))
    schema = f"{query} {kind}, q {queries.schema[table.vector].dataType.simpleString()}, cell int, bound double"
    w = Window.partitionBy(query).orderBy("distance", table.key)
    best = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found, pairs, cells = None, 0, set()
    for first in (True, False):
        asking = own
        if not first:
            kth = best(found).where(F.col("rank") == k).select(query, F.col("distance").alias("far"))
            asking = own.join(kth.groupBy(query).agg(F.max("far").alias("far")), query, "left").select(query, "q", "far")
        asked = written(asking.mapInArrow(_asks(table, k, query, first), schema), "asked")
        counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
        if counts:
            near = written(_compared(table, asked, counts, k, query, block), "nearest")
            found = near if found is None else found.unionByName(near)
        removed(asked)
        pairs, cells = pairs + sum(counts.values()), cells | set(counts)
        if found is None:  # no queries
            return Found(spark.createDataFrame([], f"{query} {kind}, {table.key} {key_kind}, distance double, rank int"), 0.0, 0.0)
    return Found(best(found), pairs / max(own.count() * len(table.cells), 1), len(cells) / len(table.cells))
