"""A property graph on disk: nodes by label, edges by type, both bucketed by the ids that joins use.

    NAME_nodes      id, labels, props     a row for each label of a node; folders by label, buckets by id
    NAME_out        src, dst              folders by edge type, buckets by src
    NAME_in         src, dst              folders by edge type, buckets by dst

A label or a type is a folder, so a pattern reads those of its own only. A hop joins on the end that
one of the two copies of the edges is bucketed by, so the edges stay where they are; where both sides
of a join are bucketed by its key, nothing is exchanged at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.graph import Graph, Pattern

BUCKETS = 64


@dataclass(frozen=True)
class StoredGraph(Graph):
    """A graph whose ``nodes`` and ``edges`` come from its tables; everything that a Graph does works."""

    spark: SparkSession
    name: str

    def label(self, *labels: str) -> DataFrame:
        """Nodes with any of the labels: only their folders are read."""
        rows = self.spark.table(f"{self.name}_nodes").where(F.col("label").isin(*labels)).select("id", "labels", "props")
        return rows if len(labels) == 1 else rows.dropDuplicates(["id"])

    def edges_of(self, type_: str, by: str) -> DataFrame:
        """src and dst of the edges of a type, bucketed by one end."""
        return self.spark.table(f"{self.name}_{'out' if by == 'src' else 'in'}").where(F.col("type") == type_).select("src", "dst")

    def chain(self, start: str, *hops: tuple[str, str, str], labels: dict[str, str] | None = None) -> Pattern:
        """A path from the variable ``start`` over hops (direction ``out`` or ``in``, type, variable), its
        variables' labels checked. Hops are joined two by two at the node between them, where both copies
        of the edges are bucketed by it; relationships of one type are pairwise distinct."""
        names = [start, *(v for _, _, v in hops)]
        rows, types = None, [t for _, t, _ in hops]
        for k in range(0, len(hops), 2):
            pair = [self._edges(k, names, hops[k], "after")]
            if k + 1 < len(hops):
                pair.append(self._edges(k + 1, names, hops[k + 1], "before"))
            elif rows is not None:  # the last one joins what is there at its first node
                pair = [self._edges(k, names, hops[k], "before")]
            part = pair[0] if len(pair) == 1 else pair[0].join(pair[1], names[k + 1])
            rows = part if rows is None else rows.join(part, names[k])
        for i in range(len(hops)):
            for j in range(i):
                if types[i] == types[j]:  # the same relationship, whichever way it is walked
                    end = lambda x, e: F.col(names[x + (e == (0 if hops[x][0] == "in" else 1))])
                    rows = rows.where((end(i, 0) != end(j, 0)) | (end(i, 1) != end(j, 1)))
        for var, label in (labels or {}).items():
            rows = rows.join(self.label(label).select(F.col("id").alias(var)), var, "left_semi")
        return Pattern(self, rows)

    def turns(self, type_: str, node: str = "node", n: str = "n") -> DataFrame:
        """For each node, how many paths (a)-[type_]->(node)<-[type_]-(b) of two different relationships there are:
        counted from the numbers of its relationships, so no path is listed. Nodes without any are left out."""
        alike = self.edges_of(type_, "dst").groupBy("dst", "src").agg(F.count("*").alias("m"))
        sizes = alike.groupBy(F.col("dst").alias(node)).agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias(n))
        return sizes.where(F.col(n) > 0)

    def _edges(self, k: int, names: list[str], hop: tuple[str, str, str], near: str) -> DataFrame:
        """Edges of a hop under the names of its variables, bucketed by its first (before) or last (after) one."""
        first, last = ("src", "dst") if hop[0] == "out" else ("dst", "src")
        return self.edges_of(hop[1], last if near == "after" else first).select(F.col(first).alias(names[k]), F.col(last).alias(names[k + 1]))


def save(graph: Graph, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> StoredGraph:
    """Write a graph's tables under ``path`` and open them. Tables of these names must not be there yet."""
    nodes = graph.nodes.withColumn("label", F.explode_outer("labels")).withColumn("label", F.coalesce("label", F.lit("")))
    for table, rows, folder, key in (("nodes", nodes, "label", "id"), ("out", graph.edges, "type", "src"), ("in", graph.edges, "type", "dst")):
        # a task writes one bucket of each folder, so a folder has a file a bucket
        dealt = rows.repartition(buckets, key)
        dealt.write.format("parquet").partitionBy(folder).bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{table}").saveAsTable(f"{name}_{table}")
    return opened(spark, name)


def opened(spark: SparkSession, name: str) -> StoredGraph:
    """A graph that was saved under this name in the catalog."""
    nodes = spark.table(f"{name}_nodes").select("id", "labels", "props").dropDuplicates(["id"])
    return StoredGraph(nodes, spark.table(f"{name}_out").select("src", "type", "dst"), spark, name)


def dropped(spark: SparkSession, name: str, path: str) -> None:
    """Forget a stored graph and delete its files."""
    for table in ("nodes", "out", "in"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
