"""Tables as views, reports, timed plug-ins."""

import json

import pytest

from trellis import plugins
from trellis.sources import reports, tables


def test_tables_and_queries(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    tables.save_tables({"things": df}, str(tmp_path), {"things": ["id"]})
    assert tables.open_tables(spark, str(tmp_path), ["things"])["things"].count() == 2
    assert tables.query(spark, "SELECT name FROM things WHERE id = :id;", {"id": 2}).first().name == "b"
    assert tables.query(spark, "SELECT * FROM things", limit=1).count() == 1
    with pytest.raises(ValueError):
        tables.query(spark, "DROP VIEW things")
    with pytest.raises(ValueError):
        tables.save_tables({"things": df.unionAll(df)}, str(tmp_path), {"things": ["id"]})


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("x|y", 1), (None, 2)], "k string, n int")
    assert reports.markdown("T", {"S": df}) == "# T\n\n## S\n\n| k | n |\n|-|-|\n| x\\|y | 1 |\n|  | 2 |\n"
    reports.write_report(spark, str(tmp_path / "r"), "T", {"S": df})
    assert json.loads(spark.read.text(str(tmp_path / "r/report.json"), wholetext=True).first()[0]) == {"S": [{"k": "x|y", "n": 1}, {"n": 2}]}
    with pytest.raises(ValueError):
        reports.rows_of(df, 1)


def test_timed_calls():
    timed = plugins.Timed(lambda x: x + 1)
    assert timed(1) == 2 and len(timed.seconds) == 1
