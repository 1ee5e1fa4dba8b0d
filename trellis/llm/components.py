"""Connected components of a graph given as an edge table.

Label propagation with pointer jumping by joins; each round is written to the
shared folder, so lineage stays short and nothing is gathered on the driver but
one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that is connected with it) for all nodes of the edges.

    Edges point to the smaller node. A round sends, for each node, its smaller
    neighbours to the least of them (large-star), then joins each node's
    neighbours below it (small-star); stars remain in the end. Both steps keep
    at most as many edges as there are, and group sizes are cut down by the
    distinct that follows each.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = materialise(pairs, "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that AQE can split the join below where a node has very many neighbours
        least = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        # large-star: neighbours above u go to u's least
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        # small-star: u and its neighbours below it go to the least of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        small = materialise(small.where("u <> v").distinct(), "small")
        stable = small.count() == pairs.count() and small.exceptAll(pairs).isEmpty()
        discard(least, large, small if stable else pairs)
        if stable:
            break
        pairs = small
    stars = pairs.groupBy("u").agg(F.min("v").alias("v"))
    roots = pairs.select(F.col("v").alias("node")).distinct().join(stars.select(F.col("u").alias("node")), "node", "left_anti")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
