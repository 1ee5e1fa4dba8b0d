"""Read-only statements: Spark parses and analyses them, and the analysed plan is held against lists.

Nothing is run. The parser tells whether there is one statement; the analysed plan tells what it would
do: its nodes, the functions behind its expressions (whatever their aliases, quotes and depth,
subqueries and lambdas included), and the relations that it reads. Names in literals, aliases and
comments are not calls, and a common table expression is not a table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

_COUNTING = re.compile(r"\b(how many|number of|count|combien|nombre)\b", re.IGNORECASE)
_SUPERLATIVE = re.compile(r"\b(most|least|highest|lowest|largest|smallest|plus|moins)\b", re.IGNORECASE)

#: Functions that run code of the host, which a statement must not call.
HOST_FUNCTIONS = frozenset({"java_method", "reflect", "try_reflect"})
#: What a plan that only reads is made of.
READING = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect Except SubqueryAlias View CTERelationDef CTERelationRef WithCTE Window Generate "
    "Expand Pivot Unpivot LocalRelation OneRowRelation Range Sample LogicalRelation LogicalRDD DataSourceV2Relation DataSourceV2ScanRelation HiveTableRelation Subquery InMemoryRelation ResolvedHint".split()
)
#: Nodes of parsed statements besides, where they only read.
_PARSED = READING | {"With", "WithWindowDefinition", "Limit"}
#: Operators of the language that are registered under names as functions are.
_OPERATORS = frozenset("and or not in like rlike ilike between isnull isnotnull when cast".split())
_QUOTED_OR_COMMENT = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|--[^\n]*|/\*.*?\*/""", re.DOTALL)


def without_comments(sql: str) -> str:
    """The statement without comments; what looks like one within quotes stays."""
    return _QUOTED_OR_COMMENT.sub(lambda m: m[1] or " ", sql).strip().rstrip(";").strip()


@dataclass
class Inspection:
    """What an analysed statement consists of."""

    nodes: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    relations: set[str] = field(default_factory=set)


_NAMES: dict[str, dict[str, set[str]]] = {}


def _function_names(spark: SparkSession) -> dict[str, set[str]]:
    """Names of the built-in functions by the class of their expressions; read once for an application."""
    known = _NAMES.setdefault(spark.sparkContext.applicationId, {})
    if not known:
        registry = spark._jsparkSession.sessionState().functionRegistry()
        listed = registry.listFunction()
        for i in range(listed.size()):
            name = listed.apply(i)
            info = registry.lookupFunction(name)
            if info.isDefined():
                known.setdefault(info.get().getClassName(), set()).add(name.funcName().lower())
    return known


def _trees(flat: list[dict]) -> Iterator[tuple[dict, list]]:
    """(node, children) of a plan or expression that Spark wrote as a list in pre-order."""

    def build(at: int) -> tuple[tuple[dict, list], int]:
        node, after, children = flat[at], at + 1, []
        for _ in range(node["num-children"]):
            child, after = build(after)
            children.append(child)
        return (node, children), after

    at = 0
    while at < len(flat):
        tree, at = build(at)
        yield tree


def _is_tree(value) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, dict) and "num-children" in x for x in value)


def _dicts(value) -> Iterator[dict]:
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for x in value:
            yield from _dicts(x)


def refused_unread(spark: SparkSession, sql: str) -> str:
    """Why a statement must not even be analysed, from its parsed form; empty if it may be. A command would run
    at once, and the analyser loads the classes that host functions name."""
    for node in _dicts(json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())):
        full = str(node.get("class", ""))
        short = full.rsplit(".", 1)[-1].rstrip("$")
        if ".command." in full or ".execution." in full or (".plans.logical." in full and short not in _PARSED and not short.startswith("Unresolved")):
            return f"{short} is not a part of a query"
        if short == "UnresolvedFunction" and (called := str(node["nameParts"]).strip("[]").split(",")[-1].strip().lower()) in HOST_FUNCTIONS:
            return f"{called} must not be called"
    return ""


def inspect(spark: SparkSession, sql: str, args: dict | None = None) -> Inspection:
    """What one statement that refused_unread() lets pass consists of. Raises what Spark raises where it cannot be analysed."""
    plan = spark.sql(sql, args=args or {})._jdf.queryExecution().analyzed()
    names, out = _function_names(spark), Inspection()

    def relation(node: dict, field_: str) -> str | None:
        table = node.get(field_)
        return ((table or {}).get("identifier") or {}).get("table") if isinstance(table, dict) else None

    def within(value) -> None:
        """Expressions and plans in the fields of a node, lists of them included."""
        if _is_tree(value):
            for tree in _trees(value):
                walk(tree)
        elif isinstance(value, list):
            for x in value:
                within(x)

    def walk(tree: tuple[dict, list]) -> None:
        node, children = tree
        full = node["class"]
        short = full.rsplit(".", 1)[-1].rstrip("$")
        plan_node = ".plans.logical." in full or short.endswith(("Relation", "RDD", "Command")) or ".command." in full
        if plan_node:
            out.nodes.add(short)
            if short == "View":  # what a view reads is its owner's matter
                out.relations.add(relation(node, "desc") or "a view without a name")
                return
            if short.endswith("Relation") and short not in ("LocalRelation", "OneRowRelation", "InMemoryRelation") or short == "LogicalRDD":
                out.relations.add(relation(node, "catalogTable") or relation(node, "tableMeta") or "a file")
        elif short.endswith("UDF") or short.endswith("UDAF") or ".python." in full:
            out.functions.add(str(node.get("udfName") or node.get("name") or short).lower())
        elif full in names:
            own = {n for n in names[full] if n.replace("_", "") == short.lower()}  # of several names the one that the class has
            out.functions.add(min(names[full] & HOST_FUNCTIONS or own or names[full]))
        for key, value in node.items():
            if key not in ("class", "num-children"):
                within(value)
        if "replacement" not in node:  # what Spark puts in place of a function is not a call of the statement's own
            for child in children:
                walk(child)

    within(json.loads(plan.toJSON()))
    return out


def check_statement(spark: SparkSession, sql: str, allow_with: bool = True, functions: set[str] | None = None, tables: set[str] | None = None, args: dict | None = None) -> tuple[bool, str]:
    """(accepted, reason). One statement that only reads; nothing is run. ``functions`` lists the functions that
    may be called (without it, all but those that run code of the host), ``tables`` the views and tables that
    may be read (without it, all that have a name), ``args`` the values of named parameters."""
    text = without_comments(sql)
    first = text.split(None, 1)[0].upper() if text else ""
    if first != "SELECT" and not (allow_with and first == "WITH"):
        return False, "the statement must start with SELECT"
    try:
        if refused := refused_unread(spark, text):
            return False, refused
        found = inspect(spark, text, args)
    except Exception as e:  # the parser's or analyser's own complaint, whatever it is
        said = str(getattr(e, "desc", None) or e).strip().splitlines()[0][:200]
        return False, f"not one valid statement: {said}"
    if refused := found.nodes - READING:
        return False, f"{sorted(refused)[0]} is not a part of a query"
    if refused := {r for r in found.relations if (r not in tables if tables is not None else r == "a file")}:
        return False, f"{sorted(refused)[0]} must not be read"
    aliases = {n: group for group in _function_names(spark).values() for n in group}
    plain = {f for f in found.functions if not _is_operator(aliases.get(f, {f}))}
    refused = plain & HOST_FUNCTIONS if functions is None else {f for f in plain if not aliases.get(f, {f}) & functions}
    return (False, f"{sorted(refused)[0]} must not be called") if refused else (True, "")


def _is_operator(names: set[str]) -> bool:
    return bool(names & _OPERATORS) or any(not re.fullmatch(r"[a-z_]\w*", n) for n in names)


def needs_aggregate(question: str, sql: str) -> tuple[bool, str]:
    """(passes, reason): a counting question needs an aggregate or distinct."""
    if _COUNTING.search(question) and not re.search(r"\b(count|sum|group\s+by|distinct)\b", sql, re.IGNORECASE):
        return False, "the question counts, the statement does not"
    return True, ""


def needs_ties(question: str, sql: str) -> tuple[bool, str]:
    """(passes, reason): a superlative must not be cut off by LIMIT 1."""
    if _SUPERLATIVE.search(question) and re.search(r"\blimit\s+1\b(?!\d)", sql, re.IGNORECASE):
        return False, "LIMIT 1 loses ties; compare with the maximum"
    return True, ""


def answer(spark: SparkSession, question: str, generate, attempts: int = 3):
    """Ask ``generate(question, feedback)`` for a statement until one passes every gate and runs.
    Returns (DataFrame or None, statement, attempts made, last reason). The generator is a plug-in."""
    feedback, sql = "", ""
    for made in range(1, attempts + 1):
        sql = generate(question, feedback)
        for gate in (lambda: check_statement(spark, sql), lambda: needs_aggregate(question, sql), lambda: needs_ties(question, sql)):
            ok, feedback = gate()
            if not ok:
                break
        else:
            try:
                return spark.sql(sql), sql, made, ""
            except Exception as e:
                feedback = str(e).splitlines()[0]
    return None, sql, attempts, feedback
