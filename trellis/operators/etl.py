"""From a property graph to relational tables, fact sheets and prose, with checks that nothing is made up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.graph import Graph


@dataclass(frozen=True)
class Link:
    """A column with the node at the other end of an edge (the least id if there are several)."""

    column: str
    type: str
    forward: bool = True
    required: bool = False


@dataclass(frozen=True)
class TableSpec:
    """Rows are the nodes with any of the labels."""

    name: str
    labels: tuple[str, ...]
    key: str
    props: dict[str, str] = field(default_factory=dict)  # column -> property
    links: tuple[Link, ...] = ()
    label_column: str | None = None  # first of the labels that the node has
    derived: dict[str, Column | Callable[[], Column]] = field(default_factory=dict)  # functions where no session exists yet


def project_table(graph: Graph, spec: TableSpec) -> DataFrame:
    """One table. A required link is an inner join, any other a left join."""
    rows = graph.label(*spec.labels)
    label = [F.get(F.filter("labels", lambda x: x.isin(*spec.labels)), F.lit(0)).alias(spec.label_column)] if spec.label_column else []
    table = rows.select(F.col("id").alias(spec.key), *[F.element_at("props", F.lit(p)).alias(c) for c, p in spec.props.items()], *label)
    for link in spec.links:
        one, other = ("src", "dst") if link.forward else ("dst", "src")
        ends = graph.edges.where(F.col("type") == link.type).groupBy(F.col(one).alias(spec.key)).agg(F.min(other).alias(link.column))
        table = table.join(ends, spec.key, "inner" if link.required else "left")
    derived = {c: e() if callable(e) else e for c, e in spec.derived.items()}
    return table.withColumns(derived) if derived else table


def project_relation(graph: Graph, type_: str, left: str, right: str, left_labels: tuple[str, ...] = (), right_labels: tuple[str, ...] = ()) -> DataFrame:
    """A two-column table of the distinct edges of a type between nodes of the labels."""
    edges = graph.edges.where(F.col("type") == type_).select(F.col("src").alias(left), F.col("dst").alias(right)).distinct()
    for column, labels in ((left, left_labels), (right, right_labels)):
        if labels:
            edges = edges.join(graph.label(*labels).select(F.col("id").alias(column)), column, "left_semi")
    return edges.select(left, right)


def project_all(graph: Graph, specs: list[TableSpec]) -> dict[str, DataFrame]:
    return {s.name: project_table(graph, s) for s in specs}


def nest(base: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """Fact sheets: for each part (with the key among its columns) an array of structs of its other
    columns, in order; an empty array where there is nothing. Every part is grouped apart."""
    for name, part in parts.items():
        fields = [c for c in part.columns if c != key]
        entry = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
        grouped = part.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias(name))
        kind = grouped.schema[name].dataType.simpleString()
        base = base.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return base


def render(intro: Column, *sections: tuple[str, str, Column]) -> Column:
    """Prose: an introduction, then for each (title, array column, sentence of an element) a
    paragraph, left out where the array is empty. The sentence is a function of the element."""
    paragraphs = [F.when(F.size(array) > 0, F.concat(F.lit(title + " "), F.array_join(F.transform(F.col(array), sentence), " "))) for title, array, sentence in sections]
    return F.concat_ws("\n\n", intro, *paragraphs)


#: Fixed patterns of atomic facts in prose: identifiers, frequencies, durations, quoted names.
FACTS = (r"\b([A-Z][A-Za-z]*_[A-Za-z0-9_]+)\b", r"\b(\d+(?:\.\d+)?Hz)\b", r"\b(\d+min)\b", r"«\s*([^»]+?)\s*»")


def facts_in(text: Column) -> Column:
    """The distinct atomic facts that a text states."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FACTS])))


def trace(documents: DataFrame, sheets: DataFrame, key: str, text: str = "text", facts: str = "facts") -> DataFrame:
    """key, invented (facts of the text that are not among the sheet's), verdict PASS or FAIL."""
    both = documents.select(key, F.col(text).alias("__text")).join(sheets.select(key, F.col(facts).alias("__facts")), key, "left")
    invented = F.sort_array(F.array_except(facts_in(F.col("__text")), F.coalesce("__facts", F.array().cast("array<string>"))))
    return both.select(key, invented.alias("invented"), F.when(F.size(invented) == 0, "PASS").otherwise("FAIL").alias("verdict"))


def spot_check(df: DataFrame, key: str, group: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """A seeded sample of a given size from each group (a sampling operator: the limit is its purpose)."""
    picks = [df.where(F.col(group) == g).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n) for g, n in sizes.items()]
    return reduce(lambda a, b: a.unionByName(b), picks)


def role_phase_rollup(rows: DataFrame, phase: str, role: str, member: str) -> DataFrame:
    """Members of each role in each phase, and what each phase has that no other phase has."""
    sets = rows.groupBy(role, phase).agg(F.sort_array(F.collect_set(member)).alias("members"))
    elsewhere = rows.groupBy(role, member).agg(F.count_distinct(phase).alias("__n"))
    alone = rows.join(elsewhere.where("__n = 1"), [role, member]).groupBy(role, phase).agg(F.sort_array(F.collect_set(member)).alias("only_here"))
    return sets.join(alone, [role, phase], "left").withColumn("only_here", F.coalesce("only_here", F.array().cast("array<string>")))


def fits_role_phase(rows: DataFrame, role: str, phase: str, roles: list[str], phases: list[str], *keys: str) -> DataFrame:
    """One row (of each group of keys), ``fits``: some role and some phase are known, and there are two phases or more."""
    known = lambda c, values: F.coalesce(F.bool_or(F.col(c).isin(values)), F.lit(False))
    return rows.groupBy(*keys).agg((known(role, roles) & known(phase, phases) & (F.count_distinct(phase) >= 2)).alias("fits"))
