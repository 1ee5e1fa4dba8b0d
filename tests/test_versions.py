"""Tables replaced whole, and kept for a time."""

import pytest
from pyspark.sql import functions as F

from trellis.sources import versions


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    table = versions.Versions(spark, str(tmp_path / "t"))
    rows = spark.range(20).repartition(4)
    with pytest.raises(FileNotFoundError):
        table.read("id long")
    assert table.replace(rows) == 1 and table.read("id long").count() == 20
    reading = table.read("id long")
    with pytest.raises(Exception, match="broken off"):
        table.replace(rows.select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken off")).cast("long")).otherwise(F.col("id")).alias("id")))
    assert table.current()[0] == 1 and table.read("id long").count() == 20
    assert table.replace(rows.limit(3)) == 2 and table.read("id long").count() == 3 and reading.count() == 20  # a reader that has begun
    for n in (3, 4):
        table.replace(rows.limit(n))
    assert table.read("id long").count() == 4 and table.numbers() == [3, 4]
    assert not [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(".current")]


def test_a_cache_of_other_sessions(spark, tmp_path):
    path, made = str(tmp_path / "c"), []

    def make():
        made.append(len(made))
        return spark.createDataFrame([(len(made),)], "n int")

    ask = lambda session, now: versions.cached(session, path, make, 60, now).first()[0]
    assert [ask(spark, 0), ask(spark.newSession(), 60), ask(spark, 61), ask(spark, 70), ask(spark, 200)] == [1, 1, 3, 3, 5]
