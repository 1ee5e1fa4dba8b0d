"""Vector top-k, staged merging and re-ranking, entity matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators import squares
from trellis.session import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def normalised_cosine(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, vector: str = "embedding", key: str = "vec_id", decimals: int = 6) -> DataFrame:
    """The k nearest by squared distance (rounded, ties by key): exact, one pass, each task keeps k rows."""
    rows = vectors if where is None else vectors.where(where)
    near = rows.withColumn("distance", F.round(squared_distance(F.col(vector), F.array(*map(F.lit, query))), decimals))
    return near.orderBy("distance", key).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", query: str = "query_id", max_queries: int = squares.QUERIES, decimals: int = 6) -> DataFrame:
    """The k nearest of each of a stated set of queries: query, key, distance (rounded), rank; ties by key.

    Vectors and queries are compared in squares of squares.SIDE vectors by max_queries queries, which give k rows
    a query each; these are written to the shared folder, and the best of them are ranked. Vectors
    that are null, or of another size than a query, have no distance from it and come last."""
    sizes = [(r["size"], r["n"]) for r in queries.groupBy(F.coalesce(F.size(vector), F.lit(-1)).alias("size")).agg(F.count("*").alias("n")).collect()]  # a row a size
    n, tasks = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-n // squares.SIDE), min(tasks, n // 1000))
    found = None
    for size, asked in sizes:
        down = max(1, -(-asked // max_queries))
        fit = squares.usable(F.col(vector), size)
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        dealt = lambda count, *by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
        own = queries.where(F.coalesce(F.size(vector), F.lit(-1)) == size)
        left = vectors.where(fit).select(key, vector, dealt(across, key, vector).alias("__x")).withColumn("__y", every(down))
        right = own.where(fit).select(query, F.col(vector).alias("__q"), dealt(down, query, vector).alias("__y")).withColumn("__x", every(across))
        near = squares.compared(left, right, ["__x", "__y"], k, decimals, key, vector, query, "__q")
        far = F.lit(None).cast("double").alias("distance")
        last = vectors.where(~fit).select(key).orderBy(key).limit(k)
        near = near.unionByName(own.where(fit).select(query).crossJoin(F.broadcast(last)).select(query, key, far))
        near = near.unionByName(own.where(~fit).select(query).crossJoin(F.broadcast(vectors.select(key).orderBy(key).limit(k))).select(query, key, far))
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = queries.select(query).crossJoin(vectors.select(key)).withColumn("distance", F.lit(None).cast("double")).where("false")
    w = Window.partitionBy(query).orderBy(F.col("distance").asc_nulls_last(), key)
    return written(found, "nearest").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge(pools: DataFrame, k: Column | int, anchored: Column | None = None) -> DataFrame:
    """Merge of ranked pools: question_id, doc_id, pool (0 forced, 1 preferred, 2 general), position.

    A document that is in several pools counts where it comes first. Forced documents stand
    first; if ``anchored`` holds for any other document, those with it move ahead of the rest.
    Returns question_id, doc_id, rank (1 to k)."""
    once = pools.withColumn("__first", F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy("pool", "position"))).where("__first = 1")
    bucket = F.when(F.col("pool") == 0, 0).when(anchored if anchored is not None else F.lit(False), 1).otherwise(2)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(bucket, "pool", "position", "doc_id")))
    return ranked.where(F.col("rank") <= k).select("question_id", "doc_id", "rank")


#: Nodes of one depth of a trie that are sent to all tasks, and their characters, at most; more are joined.
SENT_NODES, SENT_CHARS = 50_000, 4_000_000
_WORD = r"[\p{L}\p{N}_]+"


def _pieces(text: Column) -> Column:
    """word, what stands between, word, ...: from the first word to the last, in lower case."""
    words, between = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD, -1)
    both = F.transform(words, lambda w, i: F.array(F.lower(w), F.lower(F.get(between, i + 1))))
    return F.flatten(both)


def name_trie(entities: DataFrame, name: str = "name", least: int = 3) -> DataFrame:
    """depth, prefix, names, more: the nodes of a trie over words. A node is the first ``depth`` words of some
    names, with what stands between them, in lower case; ``names`` end there, and ``more`` says whether any goes on."""
    named = entities.where((F.length(F.col(name)) >= least) & F.col(name).rlike(r"^[\p{L}\p{N}_](.*[\p{L}\p{N}_])?$")).select(F.col(name).alias("name")).distinct()
    cut = named.withColumn("pieces", _pieces(F.col("name"))).withColumn("words", (F.size("pieces") / 2).cast("int"))
    prefixes = cut.withColumn("depth", F.explode(F.sequence(F.lit(1), "words"))).select("depth", F.array_join(F.slice("pieces", F.lit(1), F.col("depth") * 2 - 1), "").alias("prefix"), F.when(F.col("depth") == F.col("words"), F.col("name")).alias("name"))
    return prefixes.groupBy("depth", "prefix").agg(F.collect_set("name").alias("names"), F.max(F.col("name").isNull()).alias("more"))


def entity_mentions(texts: DataFrame, entities: DataFrame, key: str, text: str = "text", name: str = "name", cap: int | None = 5, least: int = 3) -> DataFrame:
    """key, name, place: the entities that a text mentions as whole words, case aside, longest first.

    Texts and names are cut into words (runs of letters, digits and _). Names form a trie over their
    words, and each place of a text goes down it word by word: an equal join on all words so far, so a
    first word that very many names share only lets a place go on, and the work grows with the texts and
    the depth, never with texts times names. A depth of the trie is sent to all tasks where its size,
    which is counted, allows, and joined otherwise. A name must start and end with a word character."""
    trie = name_trie(entities, name, least).persist()
    sizes = {r["depth"]: (r["n"], r["size"]) for r in trie.groupBy("depth").agg(F.count("*").alias("n"), F.sum(F.length("prefix") + F.length(F.array_join("names", ""))).alias("size")).collect()}  # a row a depth
    deepest = max(sizes, default=0)
    rows = texts.select(F.col(key).alias("at"), F.col(text).alias("text"))
    if deepest <= 1:
        words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
        rows = rows.select("at", F.explode(F.array_distinct(F.transform(words, lambda w: F.array(F.lower(w))))).alias("rest"))
    else:
        places = F.transform(F.sequence(F.lit(1), F.size("pieces") - 1, F.lit(2)), lambda i: F.slice("pieces", i, F.lit(2 * deepest - 1)))
        rows = rows.withColumn("pieces", _pieces(F.col("text"))).where(F.size("pieces") > 0).select("at", F.explode(F.array_distinct(places)).alias("rest"))
    met = None
    for depth in range(1, deepest + 1):
        nodes = trie.where(F.col("depth") == depth).select("prefix", "names", "more")
        if sizes[depth][0] <= SENT_NODES and sizes[depth][1] <= SENT_CHARS:
            nodes = F.broadcast(nodes)
        rows = rows.where(F.size("rest") >= 2 * depth - 1).withColumn("prefix", F.array_join(F.slice("rest", 1, 2 * depth - 1), "")).join(nodes, "prefix")
        ends = rows.where(F.size("names") > 0).select("at", F.explode("names").alias("name"))
        met = ends if met is None else met.unionByName(ends)
        rows = rows.where("more").select("at", "rest")
    if met is None:
        met = rows.select("at", F.lit(None).cast("string").alias("name")).where("false")
    w = Window.partitionBy("at").orderBy(F.length("name").desc(), "name")
    placed = met.distinct().withColumn("place", F.row_number().over(w)).withColumnRenamed("at", key)
    return placed if cap is None else placed.where(F.col("place") <= cap)


def effective_k(is_verification: Column, default: int = 15, verification: int = 5) -> Column:
    return F.when(is_verification, verification).otherwise(default)


def latest(updates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert by key: the last row of each key stays."""
    w = Window.partitionBy(key).orderBy(*order)
    return updates.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def list_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key).distinct()


def fetch(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(ids.select(key).distinct(), key, "left_semi")
