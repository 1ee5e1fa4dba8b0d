"""Named queries: documents, pages, vectors, conversations, scores and events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.operators import evaluation as E
from trellis.operators import fusion as U
from trellis.operators import pivots
from trellis.operators import retrieval as R
from trellis.plans.catalog import register
from trellis.session import scratch_dir
from trellis.session import table as t
from trellis.streaming.incremental import pending

# ---- text functions ---------------------------------------------------------------------


@register("html_strip", "SELECT page_id, substring(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 1, 500) AS summary FROM pages")
def html_strip(spark, d):
    return t(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("summary"))


@register(
    "slug_names",
    "SELECT s_suppkey, coalesce(nullif(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9_\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug FROM supplier",
)
def slug_names(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", X.slug(F.col("s_name")).alias("slug"))


@register("local_names", "SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1) ELSE split_part(url, '/', -1) END AS name FROM pages")
def local_names(spark, d):
    return t(spark, d, "pages").select("page_id", X.local_name(F.col("url")).alias("name"))


@register(
    "shorten_text",
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM documents)
    SELECT doc_id, CASE WHEN length(x) > 60 THEN substring(x, 1, 57) || '...' ELSE x END AS short FROM f""",
)
def shorten_text(spark, d):
    return t(spark, d, "documents").select("doc_id", X.shorten(F.col("text"), 60).alias("short"))


@register("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@register(
    "cue_gate",
    """SELECT conv_id, turn, regexp_matches(lower(text), 'how many|count|total') AS wants_count, contains(lower(text), '?') AS is_question FROM conversations WHERE role = 'user'""",
)
def cue_gate(spark, d):
    q = X.normalise_question(F.col("text"))
    rows = t(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", X.contains_any(q, ["how many", "count", "total"]).alias("wants_count"), X.contains_any(q, ["?"]).alias("is_question"))


@register(
    "taxonomy_literals",
    """SELECT doc_id, CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'copyright') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER) AS n FROM documents""",
)
def taxonomy_literals(spark, d):
    return t(spark, d, "documents").select("doc_id", F.coalesce(F.size(X.literals_in(F.col("text"), ["License", "Copyright", "THE"])), F.lit(None)).cast("int").alias("n"))


@register(
    "entity_match",
    r"""WITH m AS (SELECT doc_id, name FROM documents, (SELECT unnest(['license', 'version', 'copyright', 'apache', 'under']) AS name)
      WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])' || name || '([^\p{L}\p{N}_]|$)'))
    SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS INTEGER) AS place FROM m QUALIFY place <= 3""",
)
def entity_match(spark, d):
    names = spark.createDataFrame([(n,) for n in ("license", "version", "copyright", "apache", "under", "of")], "name string")
    return R.entity_mentions(t(spark, d, "documents"), names, "doc_id", cap=3)


# ---- vectors ----------------------------------------------------------------------------

_DIST = "round(list_sum(list_transform(range(1, 65), lambda i: (CAST({a}.embedding[i] AS DOUBLE) - CAST({b}.embedding[i] AS DOUBLE)) * (CAST({a}.embedding[i] AS DOUBLE) - CAST({b}.embedding[i] AS DOUBLE)))), 4)"


def _query(spark, d, vec_id=0):
    return t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


@register("vector_topk", f"SELECT e.vec_id, {_DIST.format(a='e', b='q')} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, e.vec_id LIMIT 10")
def vector_topk(spark, d):
    return R.top_k(t(spark, d, "embeddings"), _query(spark, d), 10, decimals=4).select("vec_id", "distance")


@register("vector_topk_filtered", f"SELECT e.vec_id, {_DIST.format(a='e', b='q')} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY distance, e.vec_id LIMIT 5")
def vector_topk_filtered(spark, d):
    return R.top_k(t(spark, d, "embeddings"), _query(spark, d), 5, F.col("label") == 3, decimals=4).select("vec_id", "distance")


@register(
    "vector_topk_batch",
    f"""SELECT q.vec_id AS query_id, e.vec_id, {_DIST.format(a='e', b='q')} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST.format(a='e', b='q')}, e.vec_id) AS INTEGER) AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""",
)
def vector_topk_batch(spark, d):
    """The stated query set: vectors whose id is divisible by 50, against all vectors."""
    e = t(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.top_k_batch(e, queries, 5, decimals=4)


@register(
    "vector_topk_pivots",
    f"""SELECT q.vec_id AS query_id, e.vec_id, {_DIST.format(a='e', b='q')} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST.format(a='e', b='q')}, e.vec_id) AS INTEGER) AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""",
)
def vector_topk_pivots(spark, d):
    """The same from a table partitioned by pivots, of which most pairs of queries and cells are never compared."""
    e = t(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    table = pivots.store(e, f"{scratch_dir(spark)}/pivots-{uuid.uuid4().hex}")
    return pivots.nearest(table, queries, 5, decimals=4).rows


@register(
    "cosine_similarity",
    """SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS cos, round((list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) + 1) / 2, 4) AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""",
)
def cosine_similarity(spark, d):
    q = F.array(*map(F.lit, _query(spark, d)))
    return t(spark, d, "embeddings").select("vec_id", F.round(R.cosine(F.col("embedding"), q), 4).alias("cos"), F.round(R.normalised_cosine(F.col("embedding"), q), 4).alias("similarity"))


@register(
    "retrieval_merge",
    f"""WITH general AS (SELECT e.vec_id AS doc_id, 2 AS pool, row_number() OVER (ORDER BY {_DIST.format(a='e', b='q')}, e.vec_id) AS position FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY position <= 15),
    preferred AS (SELECT e.vec_id AS doc_id, 1 AS pool, row_number() OVER (ORDER BY {_DIST.format(a='e', b='q')}, e.vec_id) AS position FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label = 3 QUALIFY position <= 5),
    forced AS (SELECT 7 AS doc_id, 0 AS pool, 1 AS position UNION ALL SELECT 0, 0, 2),
    alls AS (SELECT * FROM general UNION ALL SELECT * FROM preferred UNION ALL SELECT * FROM forced),
    once AS (SELECT * FROM alls QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pool, position) = 1)
    SELECT CAST(1 AS INTEGER) AS question_id, CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (ORDER BY CASE WHEN pool = 0 THEN 0 WHEN doc_id % 2 = 1 THEN 1 ELSE 2 END, pool, position, doc_id) AS INTEGER) AS rank FROM once QUALIFY rank <= 12""",
)
def retrieval_merge(spark, d):
    e, q = t(spark, d, "embeddings"), _query(spark, d)

    def pool(found, number):
        return found.select("vec_id", "distance").withColumn("position", F.row_number().over(Window.orderBy("distance", "vec_id"))).select(F.col("vec_id").alias("doc_id"), F.lit(number).alias("pool"), "position")  # k rows

    forced = spark.createDataFrame([(7, 0, 1), (0, 0, 2)], "doc_id long, pool int, position int")
    pools = forced.unionByName(pool(R.top_k(e, q, 5, F.col("label") == 3, decimals=4), 1)).unionByName(pool(R.top_k(e, q, 15, decimals=4), 2))
    return R.merge(pools.withColumn("question_id", F.lit(1)), 12, F.col("doc_id") % 2 == 1)


# ---- metrics and selection --------------------------------------------------------------


@register(
    "score_buckets",
    """WITH s AS (SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 101) / 100.0 END AS v FROM labels)
    SELECT CASE WHEN v IS NULL THEN 'nan' WHEN abs(v - 1) < 1e-9 THEN 'perfect' WHEN v >= 0.75 THEN 'high' WHEN v >= 0.25 THEN 'mid' WHEN v >= 0.01 THEN 'low' ELSE 'zero' END AS bucket, count(*) AS n FROM s GROUP BY 1""",
)
def score_buckets(spark, d):
    score = F.when(F.col("doc_id") % 11 == 0, F.lit(float("nan"))).otherwise((F.col("doc_id") % 101) / 100.0)
    return t(spark, d, "labels").groupBy(E.bucket(score).alias("bucket")).agg(F.count("*").alias("n"))


@register(
    "metric_by_group",
    """SELECT lang, count(*) AS n, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS toxic_rate, round(avg(CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE quality * 1.0 END), 6) AS mean_quality
    FROM labels l JOIN documents USING (doc_id) GROUP BY lang""",
)
def metric_by_group(spark, d):
    quality = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("quality").cast("double"))
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(E.rate(F.col("toxic") == 1), 6).alias("toxic_rate"), F.round(E.average_without_nan(quality), 6).alias("mean_quality"))


@register(
    "grouping_sets_metrics",
    "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_value FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
)
def grouping_sets_metrics(spark, d):
    return E.stats_by(t(spark, d, "documents"), ["lang", "source"], "n_chars")


@register(
    "ex_stats",
    """SELECT count(*) FILTER (WHERE doc_id % 3 <> 0) AS n_applicable, count(*) FILTER (WHERE doc_id % 3 <> 0 AND quality = 1) AS n_match, count(*) FILTER (WHERE doc_id % 3 <> 0 AND quality <> 1) AS n_mismatch,
    count(*) FILTER (WHERE doc_id % 3 = 0) AS n_na, round(count(*) FILTER (WHERE doc_id % 3 <> 0 AND quality = 1) / count(*) FILTER (WHERE doc_id % 3 <> 0), 6) AS match_rate FROM labels""",
)
def ex_stats(spark, d):
    stats = E.execution_stats(F.col("quality") == 1, F.col("doc_id") % 3 != 0)
    return t(spark, d, "labels").agg(*stats).withColumn("match_rate", F.round("match_rate", 6))


@register(
    "retry_stats",
    """SELECT count(*) FILTER (WHERE doc_id % 4 > 0) AS n_retried, count(*) FILTER (WHERE doc_id % 4 > 0 AND quality = 1) AS n_recovered,
    round(count(*) FILTER (WHERE doc_id % 4 > 0 AND quality = 1) / count(*) FILTER (WHERE doc_id % 4 > 0), 6) AS recovery_rate FROM labels""",
)
def retry_stats(spark, d):
    stats = E.retry_stats(F.col("doc_id") % 4 + 1, F.col("quality") == 1)
    return t(spark, d, "labels").agg(*stats).withColumn("recovery_rate", F.round("recovery_rate", 6))


@register("worst_and_best", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 3)")
def worst_and_best(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    return docs.orderBy(F.desc("n_chars"), "doc_id").limit(5).unionAll(docs.orderBy("n_chars", "doc_id").limit(3))


_G, _C, _Q = "(doc_id * 37 % 101) / 100.0", "(doc_id * 53 % 101) / 100.0", "(doc_id * 71 % 101) / 100.0"


@register(
    "evidence_score",
    f"""SELECT doc_id, round(0.40 * ({_G}) + 0.25 * ({_C}) + 0.20 * CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {_Q} END + 0.15 * CASE WHEN doc_id % 4 + 1 > 1 THEN 0.9 ELSE 1.0 END, 6) AS evidence,
    round((({_G}) + ({_C})) / 2, 6) AS combined FROM labels""",
)
def evidence_score(spark, d):
    g, c, q = F.expr(_G.replace(".0", "D")), F.expr(_C.replace(".0", "D")), F.expr(f"IF(doc_id % 13 = 0, NULL, {_Q.replace('.0', 'D')})")
    score = U.evidence_score(g, c, q, U.execution_quality(F.col("doc_id") % 4 + 1))
    return t(spark, d, "labels").select("doc_id", F.round(score, 6).alias("evidence"), F.round(U.combined_score(g, c), 6).alias("combined"))


_PAIR_COLUMNS = {"gt": "doc_id % 3 = 0", "gx": "doc_id % 4 = 0", "tx": "doc_id % 5 = 0"}


def _selection_inputs(spark, d):
    ids = t(spark, d, "labels").select(F.col("doc_id").alias("question_id"))
    number = F.create_map(*[F.lit(x) for i, p in enumerate(U.PIPELINES) for x in (p, i)])
    live = ids.withColumn("pipeline", F.explode(F.array(*map(F.lit, U.PIPELINES)))).withColumn("k", F.element_at(number, F.col("pipeline")))
    live = live.withColumn("success", (F.col("question_id") * 7 + F.col("k") * 3) % 5 != 0)
    dimension = lambda m: ((F.col("question_id") * m + F.col("k") * 11) % 7) / F.lit(7.0)
    evidence = live.select("question_id", "pipeline", dimension(3).alias("evidence_score"), dimension(5).alias("groundedness"), dimension(2).alias("completeness"), dimension(4).alias("relevance"))
    pairs = ids
    for k, agrees in _PAIR_COLUMNS.items():
        pairs = pairs.withColumn(f"c_{k}", F.lit(True)).withColumn(f"a_{k}", F.expr(agrees.replace("doc_id", "question_id")))
    return live.select("question_id", "pipeline", "success"), evidence, pairs


_SELECT_SQL = """
WITH q AS (SELECT doc_id AS question_id, (doc_id * 7) % 5 <> 0 AS vg, (doc_id * 7 + 3) % 5 <> 0 AS vt, (doc_id * 7 + 6) % 5 <> 0 AS vx FROM labels),
p AS (SELECT *, vg AND vt AS cgt, vg AND vx AS cgx, vt AND vx AS ctx, vg AND vt AND question_id % 3 = 0 AS gt, vg AND vx AND question_id % 4 = 0 AS gx, vt AND vx AND question_id % 5 = 0 AS tx,
  CAST(vg AS INTEGER) + CAST(vt AS INTEGER) + CAST(vx AS INTEGER) AS v FROM q),
r AS (SELECT *, CAST(gt AS INTEGER) + CAST(gx AS INTEGER) + CAST(tx AS INTEGER) AS a FROM p),
g AS (SELECT *, CASE WHEN v = 0 THEN 'all_pipelines_failed' WHEN v = 1 THEN 'only_one_valid' WHEN v = 2 AND a = 1 THEN 'single_pair_agreement_two_valid' WHEN v = 2 THEN 'no_agreement_two_valid'
   WHEN a = 3 THEN 'all_three_agree' WHEN a = 2 THEN 'transitivity_conflict' WHEN a = 1 THEN 'single_pair_agreement' ELSE 'no_agreement' END AS rule FROM r),
m AS (SELECT question_id, rule, unnest(['graph', 'tabular_v2', 'textual']) AS pipeline, unnest([0, 1, 2]) AS k,
   unnest([vg AND (a <> 1 OR gt OR gx), vt AND (a <> 1 OR gt OR tx), vx AND (a <> 1 OR gx OR tx)]) AS cand, gx OR tx AS textual FROM g),
c AS (SELECT *, (question_id * 3 + k * 11) % 7 AS e1, (question_id * 5 + k * 11) % 7 AS e2, (question_id * 2 + k * 11) % 7 AS e3, (question_id * 4 + k * 11) % 7 AS e4 FROM m WHERE cand),
b AS (SELECT question_id, pipeline AS selected FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY e1 DESC, e2 DESC, e3 DESC, e4 DESC, k) = 1)
SELECT g.question_id, rule, CASE WHEN rule LIKE 'single_pair%' THEN CASE WHEN gx OR tx THEN 'strong' ELSE 'moderate' END WHEN rule = 'all_three_agree' THEN 'strongest' WHEN rule = 'transitivity_conflict' THEN 'conflict' ELSE 'none' END AS strength,
  CASE WHEN rule LIKE 'single_pair%' THEN CASE WHEN gx OR tx THEN 'more_independent_sources' ELSE 'shared_upstream_source' END WHEN rule = 'all_three_agree' THEN 'all_sources_converge' WHEN rule = 'transitivity_conflict' THEN 'inconsistent' ELSE 'none' END AS independence,
  selected FROM g LEFT JOIN b USING (question_id)"""


@register("selector", _SELECT_SQL)
def selector(spark, d):
    return U.select_answers(*_selection_inputs(spark, d))


@register("selection_summary", f"WITH s AS ({_SELECT_SQL}) SELECT rule, selected, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY ALL")
def selection_summary(spark, d):
    return U.summary(U.select_answers(*_selection_inputs(spark, d)))


@register(
    "multiset_compare",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, n_left, n_right FROM (SELECT o_orderkey, 1 AS n_left, CASE WHEN o_orderkey % 1000 = 7 THEN 2 WHEN o_orderkey % 1000 = 8 THEN 0 ELSE 1 END AS n_right FROM orders) WHERE n_left <> n_right""",
)
def multiset_compare(spark, d):
    """Orders against a copy with some rows doubled and some lost; columns in another order."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    other = o.where("o_orderkey % 1000 <> 8").unionAll(o.where("o_orderkey % 1000 = 7")).select("o_orderstatus", "o_orderkey")
    diff = E.multiset_difference(E.unordered_tokens(o), E.unordered_tokens(other))
    return diff.select(F.regexp_extract("token", r"(\d+)", 1).alias("order_id"), F.col("n_left").cast("int").alias("n_left"), F.col("n_right").cast("int").alias("n_right"))


# ---- conversations and events -----------------------------------------------------------


@register("conversation_latest", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1")
def conversation_latest(spark, d):
    return R.latest(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", [F.desc("turn"), F.col("role"), F.col("text")])


@register("conversation_list", "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id")
def conversation_list(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id")


@register("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    w = t(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@register(
    "events_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def events_session(spark, d):
    s = t(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")


@register(
    "distribution_report",
    "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'weekday', CAST(dayofweek(ts) + 1 AS VARCHAR), count(*) FROM events GROUP BY 2",
)
def distribution_report(spark, d):
    """Several distributions from one pass: each row is counted once for each dimension."""
    pairs = F.array(F.struct(F.lit("event_type").alias("dimension"), F.col("event_type").alias("value")), F.struct(F.lit("weekday").alias("dimension"), F.dayofweek("ts").cast("string").alias("value")))
    return t(spark, d, "events").select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


@register("kpi_row", "SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS large, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def kpi_row(spark, d):
    return t(spark, d, "events").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("value") > 50).alias("large"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@register("resume_skip_done", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM benchmark WHERE item_id % 3 = 0)")
def resume_skip_done(spark, d):
    b = t(spark, d, "benchmark").select("item_id")
    return pending(b, b.where("item_id % 3 = 0"), "item_id")
