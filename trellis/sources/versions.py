"""Tables that are replaced whole: a reader finds the old content or the new, never a part.

Content is written to a folder of its own (v=N), and a small file, CURRENT, says which one holds. Only
when all of it is written does a new CURRENT take the old one's place, by a rename that the file
system does at once. A write that fails leaves what was there; the next one clears it away. The last
KEPT versions stay, for readers that have begun.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEPT = 2


class Versions:
    """The versions under a path, in whatever file system holds it."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        self.spark, self.path, self.kind = spark, path, kind
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._at().getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._fs.Path("/".join([self.path, *parts]))

    def current(self) -> tuple[int, float] | None:
        """Number and time (seconds since 1970) of the version that holds, or None."""
        if not self._files.exists(self._at("CURRENT")):
            return None
        line = self.spark.read.text(f"{self.path}/CURRENT").first()[0].split()
        return int(line[0]), float(line[1])

    def numbers(self) -> list[int]:
        found = self._files.globStatus(self._at("v=*")) or []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in found)

    def replace(self, df: DataFrame, now: float | None = None) -> int:
        """Write df as the next version and let it hold. Returns its number."""
        held = self.current()
        for n in self.numbers():  # left by writes that failed, or no longer read
            if held is None or n > held[0] or n <= held[0] - KEPT + 1:
                self._files.delete(self._at(f"v={n}"), True)
        number = held[0] + 1 if held else 1
        df.write.format(self.kind).mode("overwrite").save(f"{self.path}/v={number}")
        fresh = self._at(f".current-{uuid.uuid4().hex}")
        out = self._files.create(fresh, True)
        out.write(bytearray(f"{number} {time.time() if now is None else now}\n".encode()))
        out.close()
        rename = getattr(self._fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        where = self._files.makeQualified(self._at())
        self._fs.FileContext.getFileContext(where.toUri(), self._conf).rename(self._files.makeQualified(fresh), self._files.makeQualified(self._at("CURRENT")), how)
        return number

    def read(self, schema) -> DataFrame:
        """The version that holds; an error where there is none."""
        held = self.current()
        if held is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return self.spark.read.schema(schema).format(self.kind).load(f"{self.path}/v={held[0]}")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], ttl: float, now: float | None = None) -> DataFrame:
    """What make() gave at most ``ttl`` seconds ago, for every session that shares the path; made anew, and
    replaced at once, where it is older or missing. The schema is that of make()."""
    versions, now = Versions(spark, path), time.time() if now is None else now
    held, df = versions.current(), make()
    if held is None or now - held[1] > ttl:
        versions.replace(df, now)
    return versions.read(df.schema)
