"""A property graph as two DataFrames, and patterns over it that become joins.

nodes(id, labels array<string>, props map<string,string>), edges(src, type, dst).

A pattern is built step by step. Its result has one column of node ids for each
variable; matches made of the same variables join on them, and an optional
match is one left join of the whole optional pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def label(self, *labels: str) -> DataFrame:
        """Nodes with any of the labels."""
        return self.nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))

    def match(self, var: str, *labels: str, where: Column | None = None) -> Pattern:
        """Start of a pattern: one node. ``where`` is about id, labels and props."""
        return Pattern(self, self._ids(var, labels, where))

    def _ids(self, var: str, labels: tuple[str, ...], where: Column | None) -> DataFrame:
        found = self.label(*labels) if labels else self.nodes
        return (found if where is None else found.where(where)).select(F.col("id").alias(var))

    def props(self, rows: DataFrame, var: str, *labels: str, **named: str | tuple[str, ...]) -> DataFrame:
        """rows with properties of the node in column var: out=property name, or out=names of which
        the first that is set counts. A null id gives nulls. With labels, which the nodes must be known
        to have, only nodes with any of them are read."""
        value = lambda p: F.element_at("props", F.lit(p)) if isinstance(p, str) else F.coalesce(*[F.element_at("props", F.lit(x)) for x in p])
        nodes = self.label(*labels) if labels else self.nodes
        return rows.join(nodes.select(F.col("id").alias(var), *[value(p).alias(out) for out, p in named.items()]), var, "left")

    def labels_of(self, rows: DataFrame, var: str, out: str, *labels: str, at: int | None = None) -> DataFrame:
        """rows with the labels of the node in column var, or with the label at a place (from 0; null beyond)."""
        nodes = self.label(*labels) if labels else self.nodes
        value = F.col("labels") if at is None else F.get("labels", F.lit(at))
        return rows.join(nodes.select(F.col("id").alias(var), value.alias(out)), var, "left")

    def type_counts(self) -> DataFrame:
        return self.edges.groupBy("type").agg(F.count("*").alias("n"))

    def degrees(self, type_: str, n: str = "n") -> DataFrame:
        """src and the number of nodes that edges of a type lead to. Edges are distinct, so they are counted as they
        are: no join with their ends, and no second table of pairs in the memory of a task."""
        return self.edges.where(F.col("type") == type_).groupBy("src").agg(F.count("dst").alias(n))

    def label_counts(self) -> DataFrame:
        return self.nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))

    def sample_by_label(self) -> DataFrame:
        """label and the least id that has it."""
        return self.nodes.select(F.explode("labels").alias("label"), "id").groupBy("label").agg(F.min("id").alias("id"))


@dataclass(frozen=True)
class Pattern:
    graph: Graph
    rows: DataFrame
    #: (type, source, target) of the relationships of this match, by variables
    hops: tuple[tuple[str, str, str], ...] = ()

    def _hop(self, src: str, type_: str, dst: str, labels: tuple[str, ...], where: Column | None, forward: bool) -> Pattern:
        one, other = ("src", "dst") if forward else ("dst", "src")
        edges = self.graph.edges.where(F.col("type") == type_).select(F.col(one).alias(src), F.col(other).alias(dst))
        rows = self.rows.join(edges, [src, dst] if dst in self.rows.columns else src)  # the end may be bound already
        if labels or where is not None:
            rows = rows.join(self.graph._ids(dst, labels, where), dst, "left_semi")
        hop = (type_, src, dst) if forward else (type_, dst, src)
        # relationships of one match are pairwise distinct; those of different types are anyway
        for kind, a, b in self.hops:
            if kind == type_:
                rows = rows.where((F.col(a) != F.col(hop[1])) | (F.col(b) != F.col(hop[2])))
        return Pattern(self.graph, rows, (*self.hops, hop))

    def out(self, src: str, type_: str, dst: str, *labels: str, where: Column | None = None) -> Pattern:
        """(src)-[:type_]->(dst)"""
        return self._hop(src, type_, dst, labels, where, True)

    def into(self, src: str, type_: str, dst: str, *labels: str, where: Column | None = None) -> Pattern:
        """(src)<-[:type_]-(dst)"""
        return self._hop(src, type_, dst, labels, where, False)

    def table(self) -> DataFrame:
        """One column for each variable."""
        return self.rows

    def join(self, other: Pattern) -> Pattern:
        """A second match that shares variables (its relationships may repeat those of the first)."""
        right = other.table()
        shared = [c for c in self.table().columns if c in right.columns]
        return Pattern(self.graph, self.table().join(right, shared))

    def optional(self, other: Pattern) -> Pattern:
        """An optional match: one left join of the whole other pattern, its conditions included."""
        right = other.table()
        shared = [c for c in self.table().columns if c in right.columns]
        return Pattern(self.graph, self.table().join(right, shared, "left"))

    def without(self, other: Pattern) -> Pattern:
        """Rows for which the other pattern has no match (optional match with count 0)."""
        right = other.table()
        shared = [c for c in self.table().columns if c in right.columns]
        return Pattern(self.graph, self.table().join(right.select(*shared), shared, "left_anti"))

    def where(self, condition: Column | str) -> Pattern:
        return Pattern(self.graph, self.rows.where(condition), self.hops)

    def counts(self, keys: list[str], **members: str) -> DataFrame:
        """count(DISTINCT var) for each group of keys."""
        return self.table().groupBy(*keys).agg(*[F.count_distinct(v).alias(n) for n, v in members.items()])


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of (id, label, key, value) rows: labels as a sorted set; of several values of one
    key the greatest stays."""
    props = rows.where("key is not null").groupBy("id", "key").agg(F.max("value").alias("value")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("props"))
    labels = rows.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    empty = F.create_map().cast("map<string,string>")
    return labels.join(props, "id", "left").select("id", "labels", F.coalesce("props", empty).alias("props"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Keys of a node with more than one value."""
    return rows.where("key is not null").groupBy("id", "key").agg(F.sort_array(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst").distinct()


def multi_counts(*frames: DataFrame) -> DataFrame:
    """Chained one-row counts, as a cross join: no row if any of them has none."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)
