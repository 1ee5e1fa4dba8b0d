"""RDF/XML individuals to triples, and triples to a property graph.

``read_individuals`` splits files of any size at the closing tag of an element,
as lines are split; each element is parsed in its task by the standard library's
XML parser, within the opening tag of its file (a row a file, joined on the
path). ``read_triples`` takes whole files instead, with whatever they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import local_name
from trellis.operators.graph import Graph, upsert_edges, upsert_nodes

TRIPLES = "s string, p string, o string, is_literal boolean, datatype string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Types that declare the ontology itself.
DECLARATIONS = ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Ontology")


#: Triples of a batch that leaves the parser, at most (and those of one element).
BATCH = 10_000


def _elements(content: bytes):
    """The root's attributes, then its children one at a time, each forgotten when the next is asked for."""
    import io
    import xml.etree.ElementTree as ET

    depth, root = 0, None
    for event, element in ET.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            depth += 1
            if depth == 1:
                root = element
                yield element
        else:
            depth -= 1
            if depth == 1:
                yield element
                root.clear()


class _Nothing:
    """What a parser builds that only looks for errors."""

    def start(self, tag, attributes): ...
    def end(self, tag): ...
    def close(self): ...


def _well_formed(content: bytes) -> bool:
    import xml.etree.ElementTree as ET

    try:
        parser = ET.XMLParser(target=_Nothing())
        parser.feed(content)
        parser.close()
    except ET.ParseError:
        return False
    return True


def _of_file(path: str, content: bytes) -> Iterator[list[tuple]]:
    """The triples of each element of a file; no tree of the whole file is made."""
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    if not _well_formed(content):
        yield [(path, None, None, None, None)]  # reported by ``broken``
        return
    elements = _elements(content)
    base = next(elements).get("{http://www.w3.org/XML/1998/namespace}base", "")
    for subject in elements:
        s = subject.get(f"{{{RDF}}}about") or (base + "#" + subject.get(f"{{{RDF}}}ID", ""))
        out: list[tuple] = []
        if name(subject.tag) != RDF + "Description":
            out.append((s, RDF + "type", name(subject.tag), False, None))
        for link in subject:
            target = link.get(f"{{{RDF}}}resource")
            literal = target is None
            out.append((s, name(link.tag), (link.text or "") if literal else target, literal, link.get(f"{{{RDF}}}datatype") if literal else None))
        yield out


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.bool_(), pa.string()), strict=True)], ["s", "p", "o", "is_literal", "datatype"])

    for batch in batches:
        out: list[tuple] = []
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):  # a file at a time
            for found in _of_file(path.as_py(), content.as_py() or b""):
                out += found
                if len(out) >= BATCH:
                    yield packed(out)
                    out = []
        yield packed(out)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML files: s, p, o, is_literal, datatype."""
    return triples_of(spark.read.format("binaryFile").load(path))


def read_individuals(spark: SparkSession, path: str, element: str = "owl:NamedIndividual") -> DataFrame:
    """Triples of the elements of one name, from files that are split into tasks. An element that is
    no XML gives one row, as a broken file does."""
    records = spark.read.option("lineSep", f"</{element}>").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    opening = F.regexp_extract("value", r"(?s)((?:<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>\s*)?<rdf:RDF\b[^>]*>)", 1)
    heads = records.where(F.col("value").contains("<rdf:RDF")).groupBy("path").agg(F.first(opening).alias("head"))
    own = F.concat(F.lit(f"<{element}"), F.substring_index("value", f"<{element}", -1))
    bodies = records.where(F.col("value").contains(f"<{element}")).join(heads, "path", "left")
    content = F.concat(F.coalesce("head", F.lit("")), own, F.lit(f"</{element}></rdf:RDF>"))
    return triples_of(bodies.select("path", content.alias("content")))


def triples_of(files: DataFrame) -> DataFrame:
    """Triples of (path, content) rows. A file that is no XML gives one row: its path as s, and nulls."""
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_triples, TRIPLES)


def broken(triples: DataFrame) -> DataFrame:
    return triples.where("p is null").select("s").distinct()


def graph_of(triples: DataFrame, namespace: str, fallback: str = "Resource") -> Graph:
    """Nodes are subjects with a type in the namespace (or none at all: the fallback label);
    literals are properties; other triples are edges named by the upper-cased predicate.
    Subjects that declare the ontology are left out; edges to unknown nodes are dropped."""
    is_type = F.col("p") == RDF + "type"
    triples = triples.where("p is not null")
    declared = triples.where(is_type & local_name(F.col("o")).isin(*DECLARATIONS)).select("s").distinct()
    own = triples.join(declared, "s", "left_anti")
    labels = own.where(is_type & F.col("o").startswith(namespace)).select("s", local_name(F.col("o")).alias("label")).distinct()
    ids = own.select("s").distinct().join(labels, "s", "left").select("s", F.coalesce("label", F.lit(fallback)).alias("label"))
    literal = own.where("is_literal").select("s", local_name(F.col("p")).alias("key"), F.col("o").alias("value"))
    rows = ids.join(literal.unionByName(own.select("s").distinct().select("s", F.lit("uri").alias("key"), F.col("s").alias("value"))), "s")
    nodes = upsert_nodes(rows.select(local_name(F.col("s")).alias("id"), "label", "key", "value"))
    links = own.where(~F.col("is_literal") & ~is_type).select(local_name(F.col("s")).alias("src"), F.upper(local_name(F.col("p"))).alias("type"), local_name(F.col("o")).alias("dst"))
    return Graph(nodes, upsert_edges(links, nodes))
