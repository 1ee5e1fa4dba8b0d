"""RSS files, answers and the offline plug-ins."""

from pyspark.sql import functions as F

from trellis import plugins
from trellis.functions import answers as A
from trellis.sources import feeds

RSS = """<rss><channel><item><title>One</title><link>http://a</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description></item>
<item><title>Two</title><link>http://b</link><pubDate>soon</pubDate></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text("<rss><channel>")
    rows = feeds.read_rss(spark, str(tmp_path))
    assert feeds.broken(rows).count() == 1
    got = {r.title: (str(r.date), r.summary) for r in feeds.timed(rows.where("title is not null")).collect()}
    assert got == {"One": ("2024-01-01 10:00:00", "Hi"), "Two": ("None", None)}


def test_answers(spark):
    df = spark.createDataFrame([("La base ne contient PAS cela.", ["abcd", "ef"]), (None, ["a"]), ("42", [])], "a string, p array<string>")
    assert [r[0] for r in df.select(A.is_unavailable(F.col("a"))).collect()] == [True, False, False]  # a missing answer says nothing
    assert [r[0] for r in df.select(A.fit_passages(F.col("p"), 3)).collect()] == [["ab", "e"], ["a"], []]
    line = spark.createDataFrame([("x\nA | 2024 | here | d\nNONE | 1 | 2 | 3\nB | c",)], "t string")
    assert [tuple(e) for e in line.select(A.event_lines(F.col("t"))).first()[0]] == [("A", "2024", "here", "d")]


def test_offline_judges(spark):
    df = spark.createDataFrame([("the red boat", "the red boat"), ("the red boat", "9 8 7"), ("", "x"), ("error: x", "x"), (None, "x")], "a string, b string")
    score = [round(r[0], 6) for r in df.select(plugins.semantic_score(F.col("a"), F.col("b"))).collect()]
    assert score[0] == 1.0 and score[1] < 0.9 and score[2:] == [0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(plugins.same_answer(F.col("a"), F.col("b"))).collect()][0] is True
    assert plugins.judged(df, "a", "b", plugins.semantic_score).columns == ["a", "b", "judged"]
