"""Feeds as a Python data source: one partition a feed, fetched in the task within a time limit.

``spark.read.format("feeds")`` reads every feed once; ``spark.readStream`` reads what has come since:
its offset holds how many entries of each feed were read, so a restart from a checkpoint reads nothing
twice and misses nothing. A feed that fails or takes too long gives one row with the reason and no
title, and is asked again next time.

The fetcher is a plug-in: the name ``module:factory`` of a function that gives an object with

    count(address) -> int        entries that the feed has so far (cheap: the driver asks)
    fetch(address) -> bytes      the feed as RSS, the oldest entry first

Options: ``addresses`` (one a line), ``fetcher``, ``seconds`` (limit of one fetch, 10).
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from trellis.operators.calls import LimitedCaller

SCHEMA = "source string, position int, title string, link string, published string, summary string, reason string"
_FIELDS = ("title", "link", "pubDate", "description")


def fetcher_of(name: str):
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


class _Feed(InputPartition):
    def __init__(self, address: str, begin: int, end: int | None):
        self.address, self.begin, self.end = address, begin, end


def _rows(options: dict, feed: _Feed) -> Iterator[tuple]:
    """Entries begin to end of a feed, or one row with the reason why there are none."""
    import xml.etree.ElementTree as ET

    caller = LimitedCaller(fetcher_of(options["fetcher"]).fetch, float(options.get("seconds", 10)))
    try:
        content, reason, _ = caller(feed.address)
    finally:
        caller.close()
    entries = []
    if reason is None:
        try:
            entries = list(ET.fromstring(content).iter("item"))
        except ET.ParseError as e:
            reason = f"no RSS: {e}"
    if reason is not None:
        yield (feed.address, None, None, None, None, None, reason)
        return
    for k, item in enumerate(entries[feed.begin : feed.end], feed.begin):
        yield (feed.address, k, *(item.findtext(f) for f in _FIELDS), None)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Feed]:
        return [_Feed(a, 0, None) for a in _addresses(self.options)]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        yield from _rows(self.options, partition)


class FeedStreamReader(DataSourceStreamReader):
    """Offsets are {address: [entries read, failures]}: a failure is something to read, namely its reason.
    Where a feed cannot be asked right after a restart, how much of it was read is not known to the driver
    (-1): the next time it is read from its start again, so entries may come twice then, but none is missed."""

    def __init__(self, options: dict):
        self.options, self.known = options, {}

    def initialOffset(self) -> dict:
        self.known = {a: [0, 0] for a in _addresses(self.options)}
        return self.known

    def latestOffset(self) -> dict:
        caller = LimitedCaller(fetcher_of(self.options["fetcher"]).count, float(self.options.get("seconds", 10)))
        try:
            for a in _addresses(self.options):
                n, reason, _ = caller(a)
                read, failures = self.known.get(a, [-1, 0])
                self.known[a] = [int(n), failures] if reason is None else [read, failures + 1]
        finally:
            caller.close()
        return {a: list(self.known[a]) for a in _addresses(self.options)}

    def partitions(self, start: dict, end: dict) -> list[_Feed]:
        for a, at in start.items():
            self.known.setdefault(a, at)
        return [_Feed(a, max(start.get(a, [0, 0])[0], 0), at[0] if at[0] >= 0 else None) for a, at in end.items() if at != start.get(a, [0, 0])]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        yield from _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))


def _addresses(options: dict) -> list[str]:
    return [a.strip() for a in options["addresses"].splitlines() if a.strip()]


class StoredFeeds:
    """The offline fetcher: an address is a folder of text files, in order of their paths, with an entry (an ``item`` element) a line."""

    def _entries(self, address: str) -> list[str]:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)
        found = sorted(f.path for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
        lines = []
        for p in found:
            with where.open_input_stream(p) as f:
                lines += f.read().decode().splitlines()
        return lines

    def count(self, address: str) -> int:
        return len(self._entries(address))

    def fetch(self, address: str) -> bytes:
        return ("<rss><channel>" + "\n".join(self._entries(address)) + "</channel></rss>").encode()


def read_feeds(spark: SparkSession, addresses: list[str], fetcher: str, seconds: float = 10, stream: bool = False):
    """The feeds as a DataFrame, or as a stream."""
    spark.dataSource.register(FeedSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("feeds").options(addresses="\n".join(addresses), fetcher=fetcher, seconds=str(seconds)).load()
