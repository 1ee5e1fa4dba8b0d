"""Sliding windows by panes: each row goes into one pane, and panes are added up to windows.

Windows of ``width`` that start every ``slide`` overlap, so a row lies in width / slide of them (or
so). A pane is the greatest stretch that never straddles a window's edge. Rows are aggregated by pane
first, which shrinks them to a row a pane and key; only these are copied to their windows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_UNITS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def microseconds(length: str) -> int:
    """Of an interval such as ``90 minutes``: fixed units only, no months."""
    parts = re.findall(r"(\d+)\s*([a-z]+?)s?\b", length.lower())
    if not parts or any(u not in _UNITS for _, u in parts):
        raise ValueError(f"{length!r} is no interval of fixed length")
    return sum(int(n) * _UNITS[u] for n, u in parts)


def pane_of(width: str, slide: str) -> str:
    """The greatest stretch of which both the width and the slide are multiples."""
    w, s = microseconds(width), microseconds(slide)
    if not 0 < s <= w:
        raise ValueError("a slide is positive and no longer than the width")
    return f"{math.gcd(w, s)} microseconds"


def _columns(value: str, keys: list[str]) -> list[Column]:
    return [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "least", "most"]


def _panes(rows: DataFrame, ts: str, pane: str, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(F.window(ts, pane).alias("pane"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def _added(panes: DataFrame, at: Column, width: str, slide: str, keys: list[str]) -> DataFrame:
    return panes.groupBy(F.window(at, width, slide).alias("w"), *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def sliding(rows: DataFrame, ts: str, width: str, slide: str, keys: list[str], value: str) -> DataFrame:
    """window_start, window_end, keys, n, total, least and most of ``value``, for windows that have rows.
    Rows without a time are in no window; windows begin at multiples of the slide since 1970 (UTC)."""
    panes = _panes(rows.where(F.col(ts).isNotNull()), ts, pane_of(width, slide), keys, value)
    return _added(panes, F.col("pane.start"), width, slide, keys).select(*_columns(value, keys))


def sliding_stream(stream: DataFrame, ts: str, width: str, slide: str, late: str, keys: list[str], value: str, row_key: list[str]) -> DataFrame:
    """The same of a stream, each window once, when the watermark has passed its end. A row that comes later
    than ``late`` is dropped, and so is one whose ``row_key`` has come before within that time (sources send
    things again): late_rows() tells how many were late."""
    once = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark(row_key)
    panes = _panes(once, ts, pane_of(width, slide), keys, value)
    return _added(panes, F.window_time("pane"), width, slide, keys).select(*_columns(value, keys))


def late_rows(query: StreamingQuery) -> int:
    """Rows of sliding_stream() that were dropped because they were late: those that its first stateful
    operator, which sees every row on its own, refused."""
    first = [p.stateOperators[-1] for p in query.recentProgress if p.stateOperators]
    return sum(o.numRowsDroppedByWatermark for o in first)
