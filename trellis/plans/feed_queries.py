"""Named queries: feeds, answers and reports over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import answers as A
from trellis.functions import text as X
from trellis.operators import etl
from trellis.operators import shapes as S
from trellis.operators import ties as T
from trellis.plans.catalog import register
from trellis.plans.graph_queries import star_graph
from trellis.session import table as t
from trellis.sources import feeds

_DAY = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 40 AS INTEGER))"


def _articles(spark, d):
    """Documents as articles: the first line is the title, the date follows from the id."""
    docs = t(spark, d, "documents")
    date = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, doc_id % 40)")
    return docs.select(F.col("doc_id").alias("seq"), "source", F.substring_index("text", "\n", 1).alias("title"), date.alias("date"))


_ARTICLES = f"SELECT doc_id AS seq, source, split_part(text, chr(10), 1) AS title, {_DAY} AS date FROM documents"
_ONCE = f"SELECT * FROM ({_ARTICLES}) QUALIFY row_number() OVER (PARTITION BY substring(lower(title), 1, 100) ORDER BY date DESC, seq) = 1"


@register("news_merge", f"SELECT seq, source, title FROM ({_ONCE}) ORDER BY date DESC, seq LIMIT 20")
def news_merge(spark, d):
    return feeds.merged(_articles(spark, d), "seq", 20).select("seq", "source", "title")


@register("news_cap_per_source", f"SELECT seq, source FROM ({_ARTICLES}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY date DESC, seq) <= 3")
def news_cap_per_source(spark, d):
    return feeds.cap_per_source(_articles(spark, d), 3, [F.desc("date"), F.col("seq")]).select("seq", "source")


@register("news_recent", f"SELECT seq FROM ({_ONCE}) WHERE date > TIMESTAMP '2024-02-08 00:00:00' - INTERVAL 14 DAYS")
def news_recent(spark, d):
    return feeds.recent(feeds.merged(_articles(spark, d), "seq"), F.lit("2024-02-08 00:00:00").cast("timestamp")).select("seq")


@register("news_recent_fallback", f"SELECT seq FROM ({_ONCE}) ORDER BY date DESC, seq LIMIT 10")
def news_recent_fallback(spark, d):
    """Nothing is that recent: the first ten stand in."""
    return feeds.recent(feeds.merged(_articles(spark, d), "seq"), F.lit("2030-01-01 00:00:00").cast("timestamp")).select("seq")


@register("source_filter", "SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def source_filter(spark, d):
    return t(spark, d, "documents").where(F.col("source").isin("src1", "src2", "src3")).select("source").distinct()


@register(
    "days_ago_label",
    """SELECT n, CASE n WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE n || ' days ago' END AS label, count(*) AS rows FROM (SELECT doc_id % 40 AS n FROM documents) GROUP BY ALL""",
)
def days_ago_label(spark, d):
    day = F.expr("date_sub(DATE '2024-02-10', cast(doc_id % 40 as int))")
    return t(spark, d, "documents").groupBy((F.col("doc_id") % 40).alias("n"), X.days_ago(day, F.lit("2024-02-10").cast("date")).alias("label")).agg(F.count("*").alias("rows"))


@register(
    "page_links",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1)) AS x FROM pages)
    SELECT page_id, regexp_extract(x, '(?i)href="([^"]*)"', 1) AS href, substring(trim(regexp_replace(x, '<[^>]+>', '', 'g')), 1, 200) AS title FROM a""",
)
def page_links(spark, d):
    return feeds.links_in(t(spark, d, "pages")).select("page_id", "href", "title")


@register(
    "unavailable_answers",
    """SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(text), 'ne contient pas|aucun|pas disponible|impossible de répondre')) AS n_unavailable FROM conversations GROUP BY role""",
)
def unavailable_answers(spark, d):
    return t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(A.is_unavailable(F.col("text"))).alias("n_unavailable"))


@register(
    "cost_estimate",
    """SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum((length(text) // 4) / 1000.0 * 0.00015), 6) AS cost FROM documents GROUP BY lang""",
)
def cost_estimate(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.sum(A.tokens_of(F.col("text"))).alias("tokens"), F.round(F.sum(A.cost(F.col("text"), F.lit(""))), 6).alias("cost"))


@register(
    "fit_passages",
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS x, list_sum(list_transform(string_split(text, chr(10)), lambda s: length(s))) AS n FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN n <= 600 THEN x ELSE list_transform(x, lambda s: substring(s, 1, CAST(floor(length(s) * 600 / n) AS INTEGER))) END, '|') AS passages FROM p""",
)
def fit_passages(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(A.fit_passages(F.split("text", "\n"), 600), "|").alias("passages"))


@register(
    "event_lines",
    """WITH l AS (SELECT s_suppkey AS id, s_name || ' | 2024-0' || (s_suppkey % 9 + 1) || ' | place ' || s_nationkey || ' | x' AS line FROM supplier WHERE s_suppkey % 3 <> 0)
    SELECT id, trim(split_part(line, '|', 1)) AS name, trim(split_part(line, '|', 2)) AS date, trim(split_part(line, '|', 3)) AS place FROM l""",
)
def event_lines(spark, d):
    s = t(spark, d, "supplier")
    line = F.concat("s_name", F.lit(" | 2024-0"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit(" | place "), F.col("s_nationkey").cast("string"), F.lit(" | x"))
    text = F.concat(F.lit("intro\n"), F.when(F.col("s_suppkey") % 3 == 0, "NONE | a | b | c").otherwise(line), F.lit("\nshort | line"))
    return s.select(F.col("s_suppkey").alias("id"), F.explode(A.event_lines(text)).alias("e")).select("id", "e.name", "e.date", "e.place")


@register("calibration", "SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def calibration(spark, d):
    return t(spark, d, "part").groupBy("p_size", "p_brand").agg(F.count("*").alias("n")).where("n > 1")


@register(
    "role_rollup",
    """WITH x AS (SELECT DISTINCT l_returnflag AS phase, l_linestatus AS role, l_suppkey AS who FROM lineitem),
    e AS (SELECT role, who, count(DISTINCT phase) AS n FROM x GROUP BY ALL)
    SELECT phase, role, count(*) AS members, count(*) FILTER (WHERE n = 1) AS only_here FROM x JOIN e USING (role, who) GROUP BY ALL""",
)
def role_rollup(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("role"), F.col("l_suppkey").cast("string").alias("who"))
    rolled = etl.role_phase_rollup(rows, "phase", "role", "who")
    return rolled.select("phase", "role", F.size("members").cast("long").alias("members"), F.size("only_here").cast("long").alias("only_here"))


@register(
    "fact_sheets",
    """SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, coalesce((SELECT string_agg(s_name, ';' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation""",
)
def fact_sheets(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    customers = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_mktsegment")
    suppliers = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    sheets = etl.nest(n, "k", customers=customers, suppliers=suppliers)
    return sheets.select("nation", F.size("customers").cast("long").alias("customers"), F.array_join("suppliers", ";").alias("suppliers"))


@register(
    "trace_documents",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey <> 77 THEN '77Hz' ELSE '' END AS invented, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey <> 77 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM supplier""",
)
def trace_documents(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    name, rate = F.concat(F.lit("Supplier_"), F.col("id").cast("string")), F.concat(F.col("id").cast("string"), F.lit("Hz"))
    docs = s.select("id", F.concat(F.lit("It is "), name, F.lit(" at "), rate, F.when(F.col("id") % 4 == 0, " or 77Hz.").otherwise(".")).alias("text"))
    sheets = s.select("id", F.array(name, rate).alias("facts"))
    return etl.trace(docs, sheets, "id").select("id", F.array_join("invented", ",").alias("invented"), "verdict")


@register("relation_table", "SELECT DISTINCT 's' || l_suppkey AS supplier, 'p' || l_partkey AS part FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def relation_table(spark, d):
    return etl.project_relation(star_graph(spark, d), "SUPPLIES", "supplier", "part", ("Supplier",), ("Part",))


@register(
    "projected_table",
    "SELECT 'o' || o_orderkey AS order_id, o_orderstatus AS status, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS level, 'c' || o_custkey AS customer_id FROM orders JOIN customer ON c_custkey = o_custkey",
)
def projected_table(spark, d):
    """Graph to table: properties, a parsed twin and a required link."""
    spec = etl.TableSpec("orders", ("Order",), "order_id", {"status": "status", "priority": "priority"}, (etl.Link("customer_id", "PLACED", forward=False, required=True),), derived={"level": X.leading_int(F.col("priority"))})
    return etl.project_table(star_graph(spark, d), spec).select("order_id", "status", "level", "customer_id")


@register("left_join_keeps_gaps", "SELECT p_partkey, CAST(count(l_orderkey) AS BIGINT) AS n FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity = 50) ON l_partkey = p_partkey GROUP BY p_partkey")
def left_join_keeps_gaps(spark, d):
    lines = t(spark, d, "lineitem").where("l_quantity = 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t(spark, d, "part").select("p_partkey").join(lines, "p_partkey", "left").na.fill(0, ["n"])


@register("top10_participation", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def top10_participation(spark, d):
    counts = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return T.leaderboard(counts, "n", ["o_custkey"], 10)


@register("skip_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN d.text = '' THEN 'empty text' ELSE 'compared' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def skip_reasons(spark, d):
    both = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    reason = F.when(F.col("labelled").isNull(), "no label").when(F.col("text") == "", "empty text").otherwise("compared")
    return both.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@register("grouped_pivot_by_year", 'SELECT year(o_orderdate) AS y, count(*) FILTER (WHERE o_orderstatus = \'F\') AS "F", count(*) FILTER (WHERE o_orderstatus = \'O\') AS "O", count(*) FILTER (WHERE o_orderstatus = \'P\') AS "P" FROM orders GROUP BY 1')
def grouped_pivot_by_year(spark, d):
    o = t(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return S.pivot_sum(o, "y", "o_orderstatus", ["F", "O", "P"], F.lit(1).cast("long"))
