"""Reports of bounded results: JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 10_000


def rows_of(df: DataFrame, most: int = MAX_ROWS) -> list[dict]:
    """The rows of a small result; a larger one is an error."""
    rows = df.limit(most + 1).toJSON().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most; write the table instead")
    return [json.loads(r) for r in rows]


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    out = [f"# {title}"]
    for name, df in sections.items():
        rows, columns = rows_of(df), df.columns
        out += ["", f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
        out += ["| " + " | ".join("" if r.get(c) is None else str(r[c]).replace("|", "\\|") for c in columns) + " |" for r in rows]
    return "\n".join(out) + "\n"


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame]) -> None:
    """report.json and report.md under path, through Spark's file system."""
    content = {"json": json.dumps({n: rows_of(df) for n, df in sections.items()}, ensure_ascii=False), "md": markdown(title, sections)}
    for kind, text in content.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/report.{kind}")
