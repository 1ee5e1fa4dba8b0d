"""Named queries: relational shapes over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.operators import integrity
from trellis.operators import shapes as S
from trellis.operators import ties as T
from trellis.plans.catalog import register
from trellis.session import table as t

# ---- projections, filters, predicates -------------------------------------------------


@register("distinct_project", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct_project(spark, d):
    return t(spark, d, "part").select("p_brand", "p_size").distinct()


@register("point_lookup", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return t(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("filter_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('bUiLdInG')")
def filter_ci(spark, d):
    return t(spark, d, "customer").where(F.lower("c_mktsegment") == F.lower(F.lit("bUiLdInG"))).select("c_custkey", "c_mktsegment")


@register("in_list_or_not_equal", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'O'")
def in_list_or_not_equal(spark, d):
    return t(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (F.col("o_orderstatus") != "O")).select("o_orderkey", "o_orderstatus")


@register(
    "between_scalar_subqueries",
    "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN (SELECT avg(o_totalprice) FROM orders) AND (SELECT 0.9 * max(o_totalprice) FROM orders)",
)
def between_scalar_subqueries(spark, d):
    o = t(spark, d, "orders")
    ends = o.agg(F.avg("o_totalprice").alias("lo"), (0.9 * F.max("o_totalprice")).alias("hi"))  # one row
    return o.join(F.broadcast(ends), F.col("o_totalprice").between(F.col("lo"), F.col("hi")), "left_semi").select("o_orderkey")


@register("null_tests", "SELECT doc_id, lang IS NULL AS no_lang, text IS NOT NULL AS has_text FROM documents WHERE source IS NOT NULL")
def null_tests(spark, d):
    return t(spark, d, "documents").where("source is not null").select("doc_id", F.col("lang").isNull().alias("no_lang"), F.col("text").isNotNull().alias("has_text"))


@register("like_patterns", "SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%a%' AND p_brand NOT LIKE 'Brand#1%'")
def like_patterns(spark, d):
    return t(spark, d, "part").where(F.col("p_type").ilike("%a%") & ~F.col("p_brand").like("Brand#1%")).select("p_partkey", "p_name")


@register("regex_not_or_null", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority IS NULL OR NOT regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$')")
def regex_not_or_null(spark, d):
    return t(spark, d, "orders").where(F.col("o_orderpriority").isNull() | ~F.col("o_orderpriority").rlike("^[0-9]-[A-Z]+$")).agg(F.count("*").alias("n"))


# ---- aggregates -------------------------------------------------------------------------


@register("count_global", "SELECT count(*) AS n, count(lang) AS n_lang, count(DISTINCT lang) AS n_langs FROM documents")
def count_global(spark, d):
    return t(spark, d, "documents").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"), F.count_distinct("lang").alias("n_langs"))


@register("count_distinct_grouped", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def count_distinct_grouped(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("n_suppliers"), F.count("*").alias("n"))


@register(
    "group_by_multi",
    "SELECT l_returnflag, l_linestatus, l_linenumber, year(l_shipdate) AS ship_year, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL",
)
def group_by_multi(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber", F.year("l_shipdate").cast("long").alias("ship_year")).agg(F.count_distinct("l_orderkey").alias("n_orders"))


@register("having_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def having_count(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@register("having_alias", "SELECT l_orderkey, max(l_linenumber) - count(DISTINCT l_suppkey) AS gap FROM lineitem GROUP BY l_orderkey HAVING gap > 0")
def having_alias(spark, d):
    gap = (F.max("l_linenumber") - F.count_distinct("l_suppkey")).alias("gap")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(gap).where("gap > 0")


@register(
    "having_eq_max",
    "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n FROM c WHERE n = (SELECT max(n) FROM c)",
)
def having_eq_max(spark, d):
    return T.argmax_all(t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n")


@register(
    "text_minmax_vs_numeric",
    """SELECT min(p_brand) AS text_min, max(p_brand) AS text_max, min(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER)) AS num_min,
    max(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER)) AS num_max FROM part""",
)
def text_minmax_vs_numeric(spark, d):
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).try_cast("int")
    return t(spark, d, "part").agg(F.min("p_brand").alias("text_min"), F.max("p_brand").alias("text_max"), F.min(number).alias("num_min"), F.max(number).alias("num_max"))


@register(
    "parse_leading_int",
    r"SELECT o_orderpriority, CAST(regexp_extract(o_orderpriority, '^\s*(-?\d+)', 1) AS INTEGER) AS level, count(*) AS n FROM orders GROUP BY ALL",
)
def parse_leading_int(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority", X.leading_int(F.col("o_orderpriority")).alias("level")).agg(F.count("*").alias("n"))


@register("concat_sorted", "SELECT r_name, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def concat_sorted(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.count("*").alias("n"), X.sorted_list(F.col("n_name"), ",").alias("nations"))


@register(
    "collect_members",
    "SELECT n_name, count(DISTINCT s_suppkey) AS n_suppliers, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name",
)
def collect_members(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return s.groupBy("n_name").agg(F.count_distinct("s_suppkey").alias("n_suppliers"), F.array_join(F.sort_array(F.collect_set("s_name")), "|").alias("suppliers"))


@register("histogram_of_counts", "SELECT size, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size")
def histogram_of_counts(spark, d):
    return S.histogram_of_counts(t(spark, d, "orders"), "o_custkey")


@register("histogram_minimum", "SELECT size, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size ORDER BY size LIMIT 1")
def histogram_minimum(spark, d):
    return T.leaderboard(S.histogram_of_counts(t(spark, d, "orders"), "o_custkey"), "size", [], 1, ascending=True)


@register("multi_aggregate_row", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS parts_sold, (SELECT count(*) FROM supplier) AS suppliers")
def multi_aggregate_row(spark, d):
    n = lambda df: df.agg(F.count("*").alias("n"))
    return S.single_row(customers=n(t(spark, d, "customer")), orders=n(t(spark, d, "orders")), parts_sold=t(spark, d, "lineitem").agg(F.count_distinct("l_partkey")), suppliers=n(t(spark, d, "supplier")))


@register(
    "month_bucket_max",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders
      WHERE o_orderdate BETWEEN (SELECT min(o_orderdate) FROM orders) AND (SELECT max(o_orderdate) FROM orders) GROUP BY 1)
    SELECT month, n FROM m WHERE n = (SELECT max(n) FROM m)""",
)
def month_bucket_max(spark, d):
    o = t(spark, d, "orders").where("o_orderdate is not null")
    return T.argmax_all(o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")), "n")


@register("date_components", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL")
def date_components(spark, d):
    return t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count("*").alias("n"))


@register("pct_of_total", "SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def pct_of_total(spark, d):
    return S.pct_of_total(t(spark, d, "events"), "event_type")


@register(
    "map_then_regroup",
    """SELECT priority, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority FROM orders) GROUP BY 1""",
)
def map_then_regroup(spark, d):
    levels = {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}
    return t(spark, d, "orders").groupBy(S.map_values(F.col("o_orderpriority"), levels).alias("priority")).agg(F.count("*").alias("n"))


@register(
    "pivot_fill0",
    """SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS "F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS "O",
    CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS "P" FROM orders GROUP BY o_custkey""",
)
def pivot_fill0(spark, d):
    return S.pivot_sum(t(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"], F.lit(1).cast("long"))


@register(
    "categorical_order",
    "SELECT o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 0 END AS place, count(*) AS n FROM orders GROUP BY ALL",
)
def categorical_order(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus", S.in_order(F.col("o_orderstatus"), ["P", "O", "F"]).cast("int").alias("place")).agg(F.count("*").alias("n"))


# ---- superlatives -----------------------------------------------------------------------


@register(
    "argmax_ties",
    """WITH c AS (SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
    SELECT n_name, n FROM c WHERE n = (SELECT max(n) FROM c)""",
)
def argmax_ties(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    counts = t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return T.argmax_all(counts, "n")


@register(
    "argmax_ties_grouped",
    """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
    SELECT p_brand, p_size, n FROM c QUALIFY n = max(n) OVER (PARTITION BY p_brand)""",
)
def argmax_ties_grouped(spark, d):
    return T.argmax_all(t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")), "n", ["p_brand"])


@register("leaderboard_10", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10")
def leaderboard_10(spark, d):
    return T.leaderboard(t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), "n", ["l_suppkey"], 10)


@register("first_and_last", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders) OR o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def first_and_last(spark, d):
    return T.first_and_last(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@register("order_by_two", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name, n_name DESC")
def order_by_two(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", "r_name").orderBy("r_name", F.desc("n_name"))


@register(
    "natural_sort_first",
    "SELECT s_name FROM supplier ORDER BY CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT), s_name LIMIT 12",
)
def natural_sort_first(spark, d):
    return t(spark, d, "supplier").select("s_name").orderBy(*T.natural_order(F.col("s_name"))).limit(12)


# ---- joins ------------------------------------------------------------------------------


@register("join_inner", "SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def join_inner(spark, d):
    return t(spark, d, "orders").where("o_orderstatus = 'P'").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name").distinct()


@register(
    "join_chain3",
    """SELECT DISTINCT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE lower(r_name) = lower('europe') OR c_acctbal < 0""",
)
def join_chain3(spark, d):
    j = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.where((F.lower("r_name") == "europe") | (F.col("c_acctbal") < 0)).select("r_name", "n_name", "c_mktsegment").distinct()


@register(
    "join_left_composite",
    """SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey AS returned_by FROM lineitem a
    LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
)
def join_left_composite(spark, d):
    a = t(spark, d, "lineitem")
    b = a.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("returned_by"))
    return a.select("l_orderkey", "l_linenumber").join(b, ["l_orderkey", "l_linenumber"], "left")


@register("semi_tuple_in", "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def semi_tuple_in(spark, d):
    return S.semi_having(t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], F.count("*") > 1)


@register("anti_isnull", "SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def anti_isnull(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_not_in(spark, d):
    """A null-aware anti join: the SQL form keeps NOT IN's meaning for null keys."""
    wanted = "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)"
    return spark.sql(wanted, part=t(spark, d, "part"), lineitem=t(spark, d, "lineitem"))


@register(
    "anti_with_total",
    "SELECT c_custkey, (SELECT count(*) FROM customer) AS n_customers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
def anti_with_total(spark, d):
    c = t(spark, d, "customer")
    none = c.join(t(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
    return none.crossJoin(F.broadcast(c.agg(F.count("*").alias("n_customers"))))


@register(
    "corr_scalar_rewrite",
    """SELECT n_name, count(*) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers
    FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
)
def corr_scalar_rewrite(spark, d):
    """A correlated count above a GROUP BY: both sides aggregated, then joined."""
    n = t(spark, d, "nation")
    customers = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    return S.left_counts(n.join(customers, "n_nationkey"), "n_nationkey", n_suppliers=t(spark, d, "supplier").select("s_nationkey", "s_suppkey")).select("n_name", "n_customers", "n_suppliers")


@register(
    "self_join_rank_pair",
    """SELECT a.l_suppkey, a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey
    WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey""",
)
def self_join_rank_pair(spark, d):
    line = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    a, b = line.where("l_linenumber = 1").drop("l_linenumber"), line.where("l_linenumber = 2").drop("l_linenumber").withColumnRenamed("l_partkey", "other")
    return a.join(b, ["l_orderkey", "l_suppkey"]).where("l_partkey <> other").select("l_suppkey", "l_orderkey")


@register("having_two_ranks", "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY ALL HAVING count(DISTINCT l_linenumber) = 2")
def having_two_ranks(spark, d):
    return t(spark, d, "lineitem").where("l_linenumber in (1, 2)").groupBy("l_orderkey", "l_returnflag").agg(F.count_distinct("l_linenumber").alias("n")).where("n = 2").drop("n")


@register("cross_join_single_rows", "SELECT (SELECT max(l_shipdate) FROM lineitem) AS last_ship, (SELECT max(o_orderdate) FROM orders) AS last_order")
def cross_join_single_rows(spark, d):
    a = t(spark, d, "lineitem").agg(F.max("l_shipdate").alias("last_ship"))
    return a.crossJoin(t(spark, d, "orders").agg(F.max("o_orderdate").alias("last_order")))


# ---- set operations ---------------------------------------------------------------------


@register("union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def union_distinct(spark, d):
    parts = [t(spark, d, "nation").select(F.col("n_name").alias("name")), t(spark, d, "region").select("r_name"), t(spark, d, "customer").select("c_mktsegment")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@register("union_all", "SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).unionAll(t(spark, d, "supplier").select("s_nationkey"))


@register("set_difference", "SELECT l_partkey FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3")
def set_difference(spark, d):
    p = lambda c: t(spark, d, "lineitem").where(c).select("l_partkey")
    return p("l_quantity > 48").subtract(p("l_quantity < 3"))


@register("set_intersection", "SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity < 2")
def set_intersection(spark, d):
    p = lambda c: t(spark, d, "lineitem").where(c).select("l_suppkey")
    return p("l_quantity > 49").intersect(p("l_quantity < 2"))


@register(
    "ordered_dedupe_title",
    """SELECT doc_id, title FROM (SELECT doc_id, substring(lower(text), 1, 100) AS title FROM documents)
    QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1""",
)
def ordered_dedupe_title(spark, d):
    titled = t(spark, d, "documents").select("doc_id", F.substring(F.lower("text"), 1, 100).alias("title"))
    return titled.groupBy("title").agg(F.min("doc_id").alias("doc_id"))


# ---- integrity and diff -----------------------------------------------------------------


@register(
    "full_diff",
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 10 <> 3),
    b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS o_custkey FROM orders WHERE o_orderkey % 10 <> 4),
    j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_orderstatus AS sa, b.o_orderstatus AS sb, a.o_custkey AS ca, b.o_custkey AS cb
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
    SELECT o_orderkey, CASE WHEN kb IS NULL THEN 'missing_right' ELSE 'missing_left' END AS kind, NULL::VARCHAR AS field, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value FROM j WHERE ka IS NULL OR kb IS NULL
    UNION ALL SELECT o_orderkey, 'mismatch', 'o_orderstatus', sa, sb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND sa IS DISTINCT FROM sb
    UNION ALL SELECT o_orderkey, 'mismatch', 'o_custkey', CAST(ca AS VARCHAR), CAST(cb AS VARCHAR) FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ca IS DISTINCT FROM cb""",
)
def full_diff(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    key = F.col("o_orderkey")
    b = o.where(key % 10 != 4).withColumns({"o_orderstatus": F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_custkey": F.col("o_custkey") + F.when(key % 11 == 0, 1).otherwise(0)})
    return S.keyed_diff(o.where(key % 10 != 3), b, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


#: child, its key, parent, the parent's key.
LINKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


@register(
    "integrity_orphans",
    " UNION ALL ".join(f"SELECT '{c}.{f}' AS link, count(*) AS orphans FROM {c} x WHERE x.{f} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{k} = x.{f})" for c, f, p, k in LINKS),
)
def integrity_orphans(spark, d):
    return integrity.orphan_report({n: t(spark, d, n) for n in {x for c, _, p, _ in LINKS for x in (c, p)}}, LINKS)


@register(
    "pk_duplicates",
    "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def pk_duplicates(spark, d):
    return S.duplicate_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@register(
    "completeness",
    "SELECT 'lang' AS field, count(*) AS n, count(lang) AS filled FROM documents UNION ALL SELECT 'source', count(*), count(source) FROM documents UNION ALL SELECT 'text', count(*), count(text) FROM documents",
)
def completeness(spark, d):
    return integrity.completeness(t(spark, d, "documents"), ["lang", "source", "text"])


@register(
    "staleness_guard",
    """SELECT name, expected, found, expected = found AS fresh FROM (SELECT 'nation' AS name, 25 AS expected, (SELECT count(*) FROM nation) AS found
    UNION ALL SELECT 'region', 5, (SELECT count(*) FROM region) UNION ALL SELECT 'customer', 1, (SELECT count(*) FROM customer))""",
)
def staleness_guard(spark, d):
    return integrity.expected_counts({n: t(spark, d, n) for n in ("nation", "region", "customer")}, {"nation": 25, "region": 5, "customer": 1})
