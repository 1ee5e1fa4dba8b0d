"""Scalar functions of text as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_int(column: Column) -> Column:
    """'45min' -> 45; null where no number leads."""
    return F.nullif(F.regexp_extract(column, r"^\s*(-?\d+)", 1), F.lit("")).try_cast("int")


def leading_real(column: Column) -> Column:
    return F.nullif(F.regexp_extract(column, r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def strip_unit(column: Column, unit: str) -> Column:
    """'250Hz' -> 250; null where the rest is no integer."""
    return F.replace(column, F.lit(unit), F.lit("")).try_cast("int")


def local_name(uri: Column) -> Column:
    """What follows the last #, else the last /."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def slug(column: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(column, r"[^A-Za-z0-9_\-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("unknown"))


def strip_html(column: Column, limit: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(column, r"<[^>]+>", "")), 1, limit)


def shorten(column: Column, limit: int, ellipsis: str = "...") -> Column:
    """White space collapsed; cut to ``limit`` characters with an ellipsis at the end if longer."""
    flat = F.trim(F.regexp_replace(column, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - len(ellipsis)), F.lit(ellipsis))).otherwise(flat)


def unfence(column: Column) -> Column:
    """The inside of a ``` block (with or without a language name), else the text."""
    inside = F.regexp_extract(column, r"(?s)```[A-Za-z]*\s*(.*?)```", 1)
    return F.regexp_replace(F.coalesce(F.nullif(inside, F.lit("")), column), r"^\s+|\s+$", "")


def contains_any(column: Column, cues: list[str]) -> Column:
    """Whether any cue stands in the text: one expression for all cues, so the column is computed once and not once a cue."""
    return column.rlike("|".join(map(re.escape, cues))) if cues else F.lit(False)


def literals_in(column: Column, values: list[str]) -> Column:
    """The listed values that occur in the text, whatever their case."""
    lower = F.lower(column)
    return F.array_compact(F.array(*[F.when(lower.contains(F.lower(F.lit(v))), v) for v in values])) if values else F.array().cast("array<string>")


def quote(column: Column) -> Column:
    return F.concat(F.lit(r"\Q"), column, F.lit(r"\E"))


def whole_word(text: Column, word: Column) -> Column:
    """The word occurs in the text, case aside, between word boundaries."""
    return F.rlike(text, F.concat(F.lit(r"(?i)\b"), quote(word), F.lit(r"\b")))


def normalise_question(column: Column) -> Column:
    return F.translate(F.lower(column), "’`", "''")


def sorted_list(values: Column, separator: str = ", ") -> Column:
    """An aggregate: values joined in order (group_concat with an order)."""
    return F.array_join(F.sort_array(F.collect_list(values)), separator)


def days_ago(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").otherwise(F.concat(n.cast("string"), F.lit(" days ago")))


def first_other(labels: Column, generic: str) -> Column:
    """First label that is not the generic one, or null."""
    return F.get(F.filter(labels, lambda x: x != generic), F.lit(0))


def first_of(labels: Column, allowed: list[str]) -> Column:
    return F.get(F.filter(labels, lambda x: x.isin(allowed)), F.lit(0))


def iso_day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def strict_boolean(json: Column, field: str) -> Column:
    """A JSON field that is literally true or false; null for "true", 0, 1 and anything else."""
    value = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, f"$.{field}", "boolean"))


def composite_key(*columns: Column, separator: str = "|") -> Column:
    """The values of a key as one text; a null is empty, so that its place stays."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
