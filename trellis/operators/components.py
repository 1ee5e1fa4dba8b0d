"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import removed, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that is connected with it), for the nodes of the edges (long).

    In a round each node goes to the neighbour with the least hash, if that is below its own;
    pointers are followed to their ends, and the ends become the nodes of the next, smaller graph. The
    hash is another one each round, so about a third of the nodes or fewer are left whatever the
    graph is. What comes to the driver is a truth value or two a round."""
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    graph = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    levels: list[DataFrame] = []
    while not graph.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(levels))).alias("hash"), F.col(c).alias("of"))  # noqa: E731, B023
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(rank("v")).alias("low"))
        to = written(lowest.select(F.col("u").alias("node"), F.least("low", rank("u"))["of"].alias("root")), "roots")
        while True:
            far = to.select(F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = written(to.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "roots")
            removed(to)
            path, still = jumped.path, jumped.where("moved").isEmpty()
            to = jumped.select("node", "root")
            to.path = path
            if still:
                break
        levels.append(to)
        ends = graph.join(to.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(to.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        smaller = written(ends.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        removed(graph)
        graph = smaller
    removed(graph)
    label = None  # from the smallest graph back to the whole one
    for to in reversed(levels):
        if label is not None:
            last = label.select(F.col("node").alias("root"), F.col("root").alias("end"))
            to_end = to.join(last, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        else:
            to_end = to
        found = written(to_end, "labels")
        removed(to, *[label] * (label is not None))
        label = found
    alone = loops.select("node", F.col("node").alias("root"))
    label = alone if label is None else label.unionByName(alone.join(label.select("node"), "node", "left_anti"))
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.distinct().join(least, "root").select("node", "component")
