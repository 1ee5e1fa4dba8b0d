"""Named queries: sources and sinks, each written to the shared scratch folder and read back, and streams
held against their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trellis.operators import containment as C
from trellis.operators import evaluation as E
from trellis.operators import retrieval as R
from trellis.operators.graph import upsert_edges
from trellis.plans.catalog import register
from trellis.session import scratch_dir
from trellis.session import table as t
from trellis.sources import feed_source, feeds, files, rdf, reports, tables, versions
from trellis.streaming import incremental as I
from trellis.streaming import retries
from trellis.streaming import sliding as S


def _folder(spark) -> str:
    """A scratch folder, which goes when the application ends: results read it until then."""
    path = f"{scratch_dir(spark)}/sources-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


# ---- RDF ------------------------------------------------------------------------------------

_NS = "http://example.org/kb#"
_HEAD = f'<rdf:RDF xmlns:rdf="{rdf.RDF}" xmlns:kb="{_NS}" xmlns:owl="http://www.w3.org/2002/07/owl#"><owl:Class rdf:about="{_NS}Horse"/>'


#: Numbers of suppliers in the files of a nation.
_FILE = 50_000


def _rdf_files(spark, d):
    """Files for each nation, one for each _FILE numbers of suppliers, so that files do not grow with the table: the
    nation (but for number 3), its suppliers, one of their names twice, and a broken file."""
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    begin = lambda p, key, kind: F.concat(F.lit(f'<owl:NamedIndividual rdf:about="{_NS}{p}'), F.col(key).cast("string"), F.lit(f'"><rdf:type rdf:resource="{_NS}{kind}"/><kb:hasName>'))
    link = F.concat(F.lit(f'</kb:hasName><kb:competesIn rdf:resource="{_NS}N'), F.col("s_nationkey").cast("string"), F.lit('"/></owl:NamedIndividual>'))
    horses = s.select(F.col("s_nationkey").alias("k"), F.floor(F.col("s_suppkey") / _FILE).alias("part"), F.concat(begin("S", "s_suppkey", "Horse"), "s_name", link).alias("x"))
    events = n.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("k"), F.lit(0).cast("long").alias("part"), F.concat(begin("N", "n_nationkey", "Event"), "n_name", F.lit("</kb:hasName></owl:NamedIndividual>")).alias("x"))
    whole = horses.unionAll(horses.where("k = 1")).unionAll(events).groupBy("k", "part").agg(F.array_join(F.sort_array(F.collect_list("x")), "").alias("x"))
    good = whole.select(F.concat_ws("/", F.concat(F.lit("n"), F.col("k").cast("string")), F.col("part").cast("string")).alias("path"), F.concat(F.lit(_HEAD), "x", F.lit("</rdf:RDF>")).alias("content"))
    return good.unionByName(spark.createDataFrame([("broken", "<rdf:RDF")], "path string, content string"))


@register(
    "rdf_triples",
    """WITH s AS (SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_nationkey = 1), n AS (SELECT * FROM nation WHERE n_nationkey <> 3)
    SELECT 'S' || s_suppkey AS s, 'type' AS p, 'Horse' AS o, false AS is_literal FROM s UNION ALL SELECT 'S' || s_suppkey, 'hasName', s_name, true FROM s UNION ALL SELECT 'S' || s_suppkey, 'competesIn', 'N' || s_nationkey, false FROM s
    UNION ALL SELECT 'N' || n_nationkey, 'type', 'Event', false FROM n UNION ALL SELECT 'N' || n_nationkey, 'hasName', n_name, true FROM n""",
)
def rdf_triples(spark, d):
    """The individuals' triples; a type of a vocabulary's own (of every individual, and the class) is left out here."""
    from trellis.functions.text import local_name

    name = lambda c: local_name(F.col(c)).alias(c)
    own = rdf.triples_of(_rdf_files(spark, d)).where((F.col("p") != rdf.RDF + "type") | F.col("o").startswith(_NS))
    return own.select(name("s"), name("p"), F.when(F.col("is_literal"), F.col("o")).otherwise(local_name(F.col("o"))).alias("o"), "is_literal")


@register("rdf_broken", "SELECT 'broken' AS s")
def rdf_broken(spark, d):
    return rdf.broken(rdf.triples_of(_rdf_files(spark, d)))


@register("rdf_nodes", "SELECT 'S' || s_suppkey AS id, 'Horse' AS labels, s_name AS name FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'Event', n_name FROM nation WHERE n_nationkey <> 3")
def rdf_nodes(spark, d):
    """Nodes are merged from repeated triples."""
    nodes = rdf.graph_of(rdf.triples_of(_rdf_files(spark, d)), _NS).nodes
    return nodes.select("id", F.array_join("labels", ",").alias("labels"), F.element_at("props", F.lit("hasName")).alias("name"))


@register("rdf_edges", "SELECT 'S' || s_suppkey AS src, 'COMPETESIN' AS type, 'N' || s_nationkey AS dst FROM supplier WHERE s_nationkey <> 3")
def rdf_edges(spark, d):
    """Edges are distinct, their type is the upper-cased predicate, and dangling ones go."""
    return rdf.graph_of(rdf.triples_of(_rdf_files(spark, d)), _NS).edges


@register("edge_upsert", "SELECT DISTINCT 's' || l_suppkey AS src, 'SUPPLIES' AS type, 'p' || l_partkey AS dst FROM lineitem WHERE l_partkey % 2 = 0")
def edge_upsert(spark, d):
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = t(spark, d, "lineitem").select(ident("s", "l_suppkey").alias("src"), F.lit("SUPPLIES").alias("type"), ident("p", "l_partkey").alias("dst"))
    nodes = t(spark, d, "supplier").select(ident("s", "s_suppkey").alias("id")).unionAll(t(spark, d, "part").where("p_partkey % 2 = 0").select(ident("p", "p_partkey").alias("id")))
    return upsert_edges(edges, nodes)


# ---- tables and files -----------------------------------------------------------------------


@register("table_roundtrip", "SELECT n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def table_roundtrip(spark, d):
    """Tables saved with checked keys, opened as views, and asked by a statement that only reads; a second save replaces the first."""
    folder = _folder(spark)
    names = {f"kb_{n}_{uuid.uuid4().hex}": (t(spark, d, n), k) for n, k in (("supplier", "s_suppkey"), ("nation", "n_nationkey"))}
    for frames in ({n: df.limit(0) for n, (df, _) in names.items()}, {n: df for n, (df, _) in names.items()}):
        tables.save_tables(frames, folder, {n: [k] for n, (_, k) in names.items()})
    session = spark.newSession()  # its views are its own
    opened = list(tables.open_tables(session, folder, list(names)))
    return tables.query(session, f"SELECT n_name AS nation, count(*) AS suppliers FROM {opened[0]} JOIN {opened[1]} ON n_nationkey = s_nationkey GROUP BY n_name")


@register("explicit_limit", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5")
def explicit_limit(spark, d):
    session = spark.newSession()
    t(session, d, "supplier").createOrReplaceTempView("supplier")
    return tables.query(session, "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey;", limit=5)


@register("json_export", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_export(spark, d):
    folder, rows = _folder(spark), t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    files.export_json({"supplier": rows}, folder)
    return spark.read.schema(rows.schema).json(f"{folder}/supplier")


@register(
    "schema_report",
    """SELECT 's_acctbal' AS field, 'double' AS type, NULL AS samples UNION ALL SELECT 's_nationkey', 'int', NULL UNION ALL SELECT 's_suppkey', 'bigint', NULL
    UNION ALL SELECT 's_name', 'string', (SELECT array_to_string(list_sort(list(DISTINCT s_name))[1:3], '|') FROM supplier)""",
)
def schema_report(spark, d):
    return files.schema_report(t(spark, d, "supplier")).withColumn("samples", F.array_join("samples", "|"))


@register("corpus_files", "SELECT 'nation=' || n_nationkey AS entity_type, n_name || chr(10) AS text FROM nation")
def corpus_files(spark, d):
    """Text files in folders: the folder is the type of entity; blank files are left out."""
    folder = _folder(spark)
    texts = t(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("nation")).unionByName(spark.createDataFrame([(" ", 99)], "n_name string, nation int"))
    texts.repartition("nation").write.partitionBy("nation").option("compression", "none").text(folder)
    return files.read_corpus(spark, folder).select("entity_type", "text")


@register("vector_upsert", "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 7 = 0")
def vector_upsert(spark, d):
    old = t(spark, d, "embeddings").select("vec_id", "label")
    changed = old.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    new = old.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1000000)
    return files.upsert_documents(old, changed.unionByName(new), "vec_id")


@register("fetch_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def fetch_by_ids(spark, d):
    return R.fetch(t(spark, d, "documents"), R.list_ids(t(spark, d, "labels").where("toxic = 1"))).select("doc_id", "n_chars")


def _questions(spark, d) -> str:
    """A benchmark file of the parts: one JSON object with a list of questions."""
    folder = _folder(spark)
    part = t(spark, d, "part").where("p_size < 10")
    entry = F.struct(
        "p_partkey", F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("question_id"), F.col("p_name").alias("question"), F.col("p_brand").alias("ground_truth"),
        F.col("p_type").alias("category"), F.lit("easy").alias("difficulty"),
    )
    one = part.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x.dropFields("p_partkey")).alias("test_questions"))
    one.write.json(folder)
    return folder


_NUMBERED = "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal, 'Q' || p_partkey AS question_id, p_name AS question, p_type AS category FROM part WHERE p_size < 10"


@register("question_file", _NUMBERED)
def question_file(spark, d):
    return files.read_questions(spark, _questions(spark, d)).select("ordinal", "question_id", "question", "category")


@register("question_subset", f"WITH q AS ({_NUMBERED}) SELECT ordinal, question_id FROM q ORDER BY ordinal LIMIT 4 OFFSET 2")
def question_subset(spark, d):
    """From a given question on, so many."""
    path = _questions(spark, d)
    third = files.read_questions(spark, path).where("ordinal = 2").first()["question_id"]
    return files.read_questions(spark, path, start=third, limit=4).select("ordinal", "question_id")


@register("report_rows", "SELECT r_regionkey AS key, r_name AS name FROM region")
def report_rows(spark, d):
    """A report of bounded results, written as JSON and Markdown and read again."""
    folder = _folder(spark)
    reports.write_report(spark, folder, "Regions", {"regions": t(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))})
    return spark.read.schema("regions array<struct<key:int,name:string>>").json(f"{folder}/report.json").select(F.inline("regions"))


@register("cached_table", "SELECT n_nationkey, 1 AS first, 1 AS again, 2 AS later FROM nation")
def cached_table(spark, d):
    """A table kept for 300 seconds on disk: a second session reads the first version, and one that comes later makes a second."""
    folder, nation = _folder(spark), t(spark, d, "nation")
    seen = {}
    for name, session, now in (("first", spark, 1000.0), ("again", spark.newSession(), 1290.0), ("later", spark, 1301.0)):
        source = t(session, d, "nation").select("n_nationkey", F.lit(len(versions.Versions(spark, folder).numbers()) + 1).alias("made"))
        seen[name] = versions.cached(session, folder, lambda source=source: source, 300, now).collect()  # a nation a row
    parts = [spark.createDataFrame(rows, f"n_nationkey int, {name} int") for name, rows in seen.items()]
    return nation.select("n_nationkey").join(parts[0], "n_nationkey").join(parts[1], "n_nationkey").join(parts[2], "n_nationkey")


@register("atomic_json", "SELECT s_suppkey, s_name, 1 AS version FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier")
def atomic_json(spark, d):
    """JSON replaced whole: a write that breaks off in a task leaves what was there; the next one takes its place."""
    table = versions.Versions(spark, _folder(spark), "json")
    rows = t(spark, d, "supplier").select("s_suppkey", "s_name")
    table.replace(rows.where("s_suppkey % 2 = 0"))
    broken = rows.withColumn("s_name", F.when(F.col("s_suppkey") == 7, F.raise_error(F.lit("broken off"))).otherwise(F.col("s_name")))
    try:
        table.replace(broken)
        held = None
    except Exception:
        held = table.read(rows.schema).withColumn("version", F.lit(table.current()[0]))
    table.replace(rows)
    return held.unionByName(table.read(rows.schema).withColumn("version", F.lit(table.current()[0])))


@register("rss_articles", "SELECT s_name AS title, 'a & b <b>' || s_suppkey || '</b>' AS raw, 'a & b ' || s_suppkey AS summary, TIMESTAMP '2024-03-05 10:00:00' AS date FROM supplier")
def rss_articles(spark, d):
    s = t(spark, d, "supplier")
    item = F.concat(
        F.lit("<item><title>"), "s_name", F.lit("</title><link>u</link><pubDate>Tue, 5 Mar 2024 10:00:00 GMT</pubDate><description>a &amp; b &lt;b&gt;"),
        F.col("s_suppkey").cast("string"), F.lit("&lt;/b&gt;</description></item>"),
    )
    feed = s.groupBy("s_nationkey").agg(F.array_join(F.collect_list(item), "").alias("x"))
    contents = feed.select(F.col("s_nationkey").cast("string").alias("path"), F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")).alias("content"))
    found = feeds.articles_of(contents.unionByName(spark.createDataFrame([("broken", "<rss>")], "path string, content string"))).where("title is not null")
    return feeds.timed(found.withColumn("raw", F.col("summary"))).select("title", "raw", "summary", F.col("date").cast("timestamp_ntz").alias("date"))


def _feed_files(spark, d, folder: str, where: str, stage: int) -> None:
    """Entries of five feeds from the pages, in order, one a line; the fifth feed has an entry that is no XML."""
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<item><title>Page "), F.col("page_id").cast("string"), F.lit("</title><link>"), escaped, F.when(F.col("page_id") % 5 == 4, "</item>").otherwise("</link></item>"))
    pages = t(spark, d, "pages").where(where).select((F.col("page_id") % 5).alias("feed"), F.lit(stage).alias("stage"), "page_id", item.alias("value"))
    pages.coalesce(1).sortWithinPartitions("feed", "page_id").drop("page_id").write.mode("append").partitionBy("feed", "stage").text(f"{folder}/feeds")


_FEED_SQL = "SELECT page_id % 5 AS feed, CAST(row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id % 2, page_id) - 1 AS INTEGER) AS position, 'Page ' || page_id AS title, url AS link, NULL AS reason FROM pages WHERE page_id % 5 <> 4"
_FETCHER = "trellis.sources.feed_source:StoredFeeds"


def _told(rows):
    """The number of a feed instead of its address, and of a reason its first word."""
    return rows.select(F.coalesce(F.regexp_extract("source", r"feed=(\d+)$", 1).try_cast("long"), F.lit(-1)).alias("feed"), "position", "title", "link", F.regexp_extract("reason", r"^(\w+( \w+)?)", 1).alias("reason"))


@register("fetched_feeds", _FEED_SQL + " UNION ALL SELECT 4, NULL, NULL, NULL, 'no RSS' UNION ALL SELECT -1, NULL, NULL, NULL, 'FileNotFoundError' FROM (SELECT count(*) FROM pages)")
def fetched_feeds(spark, d):
    """Feeds made of the pages, each fetched in a task; one is no XML, one is not there."""
    folder = _folder(spark)
    _feed_files(spark, d, folder, "page_id % 2 = 0", 0)
    _feed_files(spark, d, folder, "page_id % 2 = 1", 1)
    addresses = [f"{folder}/feeds/feed={k}" for k in range(5)] + [f"{folder}/feeds/gone"]
    return _told(feed_source.read_feeds(spark, addresses, _FETCHER))


@register("feed_stream", _FEED_SQL + " UNION ALL SELECT 4, NULL, NULL, NULL, 'no RSS' FROM (SELECT unnest([0, 1])) UNION ALL SELECT -1, NULL, NULL, NULL, 'FileNotFoundError' FROM (SELECT unnest([0, 1]))")
def feed_stream(spark, d):
    """The same as a stream that is stopped and started again when half of the entries are there: each entry
    comes once, and each poll of a feed that fails gives its reason."""
    folder = _folder(spark)
    addresses = [f"{folder}/feeds/feed={k}" for k in range(5)] + [f"{folder}/feeds/gone"]
    for stage in (0, 1):
        _feed_files(spark, d, folder, f"page_id % 2 = {stage}", stage)
        I.append_results(feed_source.read_feeds(spark, addresses, _FETCHER, stream=True), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _told(spark.read.schema(feed_source.SCHEMA).parquet(f"{folder}/out"))


@register(
    "site_articles",
    """SELECT 'n' || s_nationkey AS page, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'http://x/' || s_suppkey ELSE 'http://site/a/' || s_suppkey END AS link, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'About it' END AS summary FROM supplier WHERE s_suppkey % 5 <> 4
    UNION ALL SELECT 'other', 'Only a list', '', ''""",
)
def site_articles(spark, d):
    """Articles of a site's pages: absolute links, no title no article, and the second kind of element where the first is missing."""
    s = t(spark, d, "supplier")
    item = F.expr("""'<ARTICLE class="x"><a href="' || CASE WHEN s_suppkey % 2 = 0 THEN 'http://x/' ELSE '/a/' END || s_suppkey || '">' || CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE '<h2 id="t"> <b>' || s_name || '</b></h2>' END || '</a>' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '<p>About <i>it</i></p><p>more</p>' END || '</article>'""")
    pages = s.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("page")).agg(F.concat(F.lit("<body><h2>News</h2>"), F.array_join(F.collect_list(item), "\n")).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([("other", '<ul><li class="menu"><h3>Menu</h3></li><li class="big-news"><h3>Only a list</h3></li></ul>'), ("none", "<p>nothing</p>")], "page string, html string"))
    site = feeds.Site("Site", "http://site", "article", None, ("div|li", "news|article"))
    return feeds.site_articles(pages, site).select("page", "title", "link", "summary")


@register(
    "recent_digest",
    """SELECT string_agg(source || ': ' || title, chr(10) ORDER BY date DESC, seq) AS text FROM (SELECT doc_id AS seq, source, substring(split_part(text, chr(10), 1), 1, 20) AS title,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 40 AS INTEGER)) AS date FROM documents ORDER BY date DESC, seq LIMIT 12)""",
)
def recent_digest(spark, d):
    date = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, doc_id % 40)")
    title = F.substring(F.substring_index("text", "\n", 1), 1, 20)
    return feeds.digest_text(t(spark, d, "documents").select(F.col("doc_id").alias("seq"), "source", title.alias("title"), date.alias("date")))


@register("conversation_crud", "SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 5 = 1 THEN 'renamed' ELSE 'c' END AS title, '2024-01-01' AS created_at FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 <> 0 UNION ALL SELECT 'new', 'hello', '2024-05-01'")
def conversation_crud(spark, d):
    """Conversations created, saved again (the creation time stays) and deleted."""
    from pyspark.sql import types as T

    empty = F.array().cast("array<struct<role:string,content:string>>")
    old = t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id")).distinct().select("id", F.lit("c").alias("title"), empty.alias("messages"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"))
    made = files.new_conversation(spark, "hello", "2024-05-01").withColumn("id", F.lit("new"))
    number = F.col("id").try_cast(T.LongType())
    saved = old.where(number % 5 == 1).withColumns({"title": F.lit("renamed"), "created_at": F.lit("2024-04-01"), "updated_at": F.lit("2024-04-01")})
    kept = files.delete_conversations(files.save_conversation(files.save_conversation(old, saved), made), old.where(number % 5 == 0))
    return kept.select("id", "title", "created_at")


# ---- streams --------------------------------------------------------------------------------


def _stream(spark, d):
    rows = t(spark, d, "events")
    return spark.readStream.schema(rows.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@register("partial_saves", "SELECT event_id, event_type FROM events WHERE value IS NOT NULL")
def partial_saves(spark, d):
    """Results appended by micro-batches; a second start finds nothing left to do."""
    folder = _folder(spark)
    for _ in range(2):
        rows = _stream(spark, d).where("value is not null").select("event_id", "event_type")
        I.append_results(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(f"{folder}/out")


@register("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Tumbling windows of a stream: what is written when the watermark has passed, and the rest, equals the batch form."""
    folder = _folder(spark)
    windows = I.tumbling(_stream(spark, d), "ts", "1 hour", "10 minutes", ["event_type"], "value")
    query = windows.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/v={k}")).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("window_start timestamp, event_type string, n long, total double, v int").parquet(f"{folder}/out")
    last = out.agg(F.max("v").alias("last"))
    return out.join(F.broadcast(last), F.col("v") == F.col("last")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("stream_first_seen", "SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id")
def stream_first_seen(spark, d):
    """Of each key the first row within the watermark, over files that come one after another: which row stays is seen."""
    folder, rows = _folder(spark), t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.least(F.floor((F.day("ts") - 1) / 8), F.lit(3))
    polled = rows.groupBy(week.alias("week"), "user_id").agg(F.min("ts").alias("ts")).select("week", "user_id", "ts")
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    for k in range(4):  # each poll of the feed brings users again
        polled.where(F.col("week") == k).drop("week").coalesce(1).write.parquet(f"{folder}/in/{k}")
        I.append_results(I.first_seen(stream, "ts", "3650 days", F.col("user_id")), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("user_id long, ts timestamp").parquet(f"{folder}/out").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, d):
    """The latest row of each key, kept up by micro-batches."""
    folder = _folder(spark)
    rows = _stream(spark, d).select("user_id", "event_id")
    I.upsert_into(spark, rows, f"{folder}/table", "user_id", "event_id", f"{folder}/checkpoint").awaitTermination()
    return I.read_upserted(spark, f"{folder}/table", "user_id long, event_id long")


def _sliding_sql(rows: str, where: str = "true") -> str:
    """Windows of 3 hours every 45 minutes: each row in its four."""
    begin = "time_bucket(INTERVAL 45 MINUTE, ts, TIMESTAMP '1970-01-01')"
    return f"""SELECT window_start, window_start + INTERVAL 3 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most
    FROM (SELECT *, unnest([{begin}, {begin} - INTERVAL 45 MINUTE, {begin} - INTERVAL 90 MINUTE, {begin} - INTERVAL 135 MINUTE]) AS window_start FROM {rows}) WHERE {where} GROUP BY ALL"""


def _sliding_columns(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "event_type", "n", F.round("total", 4).alias("total"), "least", "most")


@register("events_sliding", _sliding_sql("events"))
def events_sliding(spark, d):
    rows = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _sliding_columns(S.sliding(rows, "ts", "3 hours", "45 minutes", ["event_type"], "value"))


_CLOSED = "(SELECT max(ts) FROM events WHERE event_id % 50 <> 0) - INTERVAL 10 MINUTE"


@register(
    "stream_sliding",
    f"""WITH came AS (SELECT *, event_id % 50 = 0 AND date_trunc('milliseconds', ts) <= date_trunc('milliseconds', {_CLOSED}) AS late FROM events)
    SELECT w.*, (SELECT count(*) FROM came WHERE late) AS late_rows FROM ({_sliding_sql("(SELECT * FROM came WHERE NOT late)", f"window_start + INTERVAL 3 HOUR <= {_CLOSED}")}) w""",
)
def stream_sliding(spark, d):
    """A stream whose second file has rows that are too late (every fiftieth): its windows are those of the batch form over what came in time, and late rows are counted."""
    folder, rows = _folder(spark), t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("event_id") % 50 == 0
    rows.where(~late).coalesce(1).write.parquet(f"{folder}/in/1")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    windows = S.sliding_stream(stream, "ts", "3 hours", "45 minutes", "10 minutes", ["event_type"], "value", ["event_id"])
    query = I.append_results(windows, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    rows.where(late).coalesce(1).write.parquet(f"{folder}/in/2")
    query = I.append_results(windows, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    out = spark.read.schema(windows.schema).parquet(f"{folder}/out")
    return _sliding_columns(out).withColumn("late_rows", F.lit(S.late_rows(query)).cast("long"))


#: A question is a user's day; an event is an attempt, which passes if its value is above 60.
_ATTEMPTS = "SELECT CAST(user_id AS VARCHAR) || '/' || CAST(day(ts) AS VARCHAR) AS question, ts, value > 60 AS passed, event_type AS feedback FROM events"


@register(
    "retry_outcomes",
    f"""WITH a AS (SELECT *, epoch_ms(ts) AS ms FROM ({_ATTEMPTS})), o AS (SELECT *, row_number() OVER w AS k, CASE WHEN ms - lag(ms) OVER w > 21600000 THEN 1 ELSE 0 END AS gap FROM a WINDOW w AS (PARTITION BY question ORDER BY ts, passed, feedback)),
    v AS (SELECT *, sum(gap) OVER (PARTITION BY question ORDER BY k) AS part FROM o), r AS (SELECT question, count(*) FILTER (WHERE part = 0) AS n, min(k) FILTER (WHERE part = 0 AND passed) AS won, max(part) AS gaps,
      max(ms) FILTER (WHERE part = 0) AS last, arg_max(feedback, k) FILTER (WHERE part = 0 AND k <= 3) AS said FROM v GROUP BY question)
    SELECT question, CAST(CASE WHEN won <= 3 THEN won ELSE least(n, 3) END AS INTEGER) AS attempts, CASE WHEN won <= 3 THEN 'answered' WHEN n >= 3 THEN 'given up' ELSE 'expired' END AS outcome, CASE WHEN coalesce(won, 9) > 3 THEN said END AS feedback
    FROM r WHERE won <= 3 OR n >= 3 OR gaps > 0 OR last + 21600000 <= (SELECT max(ms) FROM a) - 600000""",
)
def retry_outcomes(spark, d):
    """A stream of attempts in four files, stopped after two of them and started again: what each question came to."""
    folder, rows = _folder(spark), t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select(F.concat_ws("/", F.col("user_id").cast("string"), F.day("ts").cast("string")).alias("question"), "ts", (F.col("value") > 60).alias("passed"), F.col("event_type").alias("feedback"))
    part = F.least(F.floor((F.day("ts") - 1) / 8), F.lit(3))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    for k in range(4):
        rows.where(part == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
        if k % 2:  # a stop between the second and the third file
            retries.decide_into(stream, f"{folder}/decided", f"{folder}/checkpoint", 3, 6 * 3_600_000).awaitTermination()
    return retries.read_decided(spark, f"{folder}/decided").drop("decided")


# ---- comparators ----------------------------------------------------------------------------


_GOLD = "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier"
#: What is held against it: as SQL, and the same with extra columns last.
_FOUND = {
    "order of columns": "SELECT s_nationkey AS n, s_suppkey AS k FROM supplier", "extra column": "SELECT s_suppkey AS k, s_nationkey AS n, s_name AS more FROM supplier",
    "value": "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_nationkey END AS n FROM supplier", "extra row": "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey = 1",
    "half": "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_suppkey % 2 = 0",
}


def _compared(name: str, found: str) -> str:
    texts = lambda sql: f"(SELECT list_sort([CAST(k AS VARCHAR), CAST(n AS VARCHAR){', more' * ('more' in sql)}]) FROM ({sql}))"
    differ = lambda a, b: f"(SELECT count(*) FROM ({a} EXCEPT ALL {b})) + (SELECT count(*) FROM ({b} EXCEPT ALL {a}))"
    strict = f"{differ(f'({_GOLD})', f'({found})')} = 0" if "more" not in found else "false"
    inside = f"(SELECT count(DISTINCT g.k) FROM ({_GOLD}) g JOIN ({found}) f ON f.k = g.k AND f.n = g.n)"
    return f"SELECT '{name}' AS name, {strict} AS strict, {differ(texts(_GOLD), texts(found))} = 0 AS unordered, (SELECT count(*) FROM ({found})) = (SELECT count(*) FROM supplier) AND {inside} = (SELECT count(*) FROM supplier) AS contained"


@register("comparators", " UNION ALL ".join(_compared(*x) for x in _FOUND.items()))
def comparators(spark, d):
    """Strict, unordered and containing comparison of a result with others of the same table."""
    supplier = t(spark, d, "supplier")
    gold = supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    other = {
        "order of columns": gold.select("n", "k"), "extra column": gold.withColumn("more", F.lit("x")), "value": gold.withColumn("n", F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("n"))),
        "extra row": gold.unionAll(gold.where("k = 1")), "half": gold.where("k % 2 = 0"),
    }
    other["extra column"] = supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), "s_name")
    rows = [(name, E.same_result(gold, df, columns_matter=True), E.same_result(gold, df), C.contained(gold, df)) for name, df in other.items()]
    return spark.createDataFrame(rows, "name string, strict boolean, unordered boolean, contained boolean")


#: Of each month's result one in some rows is wrong (odd months), missing (June) or there twice (August).
_ODD = "month(o_orderdate) % 2 = 1 AND o_orderkey % 97 = 0"


@register(
    "containment_match",
    f"""WITH g AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS question, o_custkey AS c, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL),
    f AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS question, o_custkey AS c, CASE WHEN {_ODD} THEN 'wrong' ELSE o_orderstatus END AS s, sum(CASE WHEN month(o_orderdate) = 8 AND o_orderkey % 50 = 0 THEN 2 ELSE 1 END) AS n
      FROM orders WHERE NOT (month(o_orderdate) = 6 AND o_orderkey % 50 = 0) GROUP BY ALL),
    m AS (SELECT question, sum(least(g.n, coalesce(f.n, 0))) AS n_matched, sum(g.n) AS n_gold FROM g LEFT JOIN f USING (question, c, s) GROUP BY question),
    h AS (SELECT question, sum(n) AS n_found FROM f GROUP BY question)
    SELECT question, CAST(n_gold AS BIGINT) AS n_gold, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found, CAST(n_matched AS BIGINT) AS n_matched, n_gold = coalesce(n_found, 0) AND n_matched = n_gold AS contained FROM m LEFT JOIN h USING (question)""",
)
def containment_match(spark, d):
    """Each month's orders as (customer, status), held against rows with more columns in another order, some of
    them wrong, missing or twice there: all months in one run."""
    rows = t(spark, d, "orders").withColumn("question", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    twice = F.when((F.month("o_orderdate") == 8) & (F.col("o_orderkey") % 50 == 0), 2).otherwise(1)
    found = rows.where(~((F.month("o_orderdate") == 6) & (F.col("o_orderkey") % 50 == 0))).withColumn("again", F.explode(F.sequence(F.lit(1), twice)))
    found = found.select("question", "o_orderpriority", F.when(F.expr(_ODD), "wrong").otherwise(F.col("o_orderstatus")).alias("status"), "o_custkey")
    gold = rows.select("question", "o_custkey", "o_orderstatus")
    return C.matches(C.rows_of(gold, ["question"]), C.rows_of(found, ["question"]), ["question"])


@register(
    "containment_chains",
    """WITH k AS (SELECT DISTINCT o_custkey AS c, o_orderstatus AS s FROM orders), run AS (SELECT s, c, c - row_number() OVER (PARTITION BY s ORDER BY c) AS part FROM k),
    size AS (SELECT s, part, count(*) AS n FROM run GROUP BY ALL) SELECT s AS status, CAST(sum(n) AS BIGINT) AS n_gold, CAST(sum(n - 1) AS BIGINT) AS n_found, CAST(sum(n - 1) AS BIGINT) AS n_matched, false AS contained FROM size GROUP BY s""",
)
def containment_chains(spark, d):
    """Rows that could each answer two expected ones, along chains of customers with neighbouring numbers: only a
    matching that moves rows on finds a place for all but one of a chain."""
    own = t(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("c")).distinct()
    pairs = own.join(own.select("status", (F.col("c") - 1).alias("c"), F.col("c").alias("next")), ["status", "c"])
    return C.matches(C.rows_of(own, ["status"]), C.rows_of(pairs.select("status", F.col("next").alias("b"), F.col("c").alias("a")), ["status"]), ["status"])


@register("list_as_set", "SELECT o_custkey, true AS as_set, count(*) = count(DISTINCT o_orderstatus) AS as_multiset FROM orders GROUP BY 1")
def list_as_set(spark, d):
    """A customer's list of order statuses and the set of them: equal as sets, and as multisets if none repeats."""
    lists = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    kind = lists.schema["a"].dataType
    same = lambda as_set: E.cell_token(F.col("a"), kind, as_set) == E.cell_token(F.col("b"), kind, as_set)
    return lists.select("o_custkey", same(True).alias("as_set"), same(False).alias("as_multiset"))
