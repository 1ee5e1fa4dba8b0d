"""The queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import chosen_path, collocations, decontam, ftrl, langid, lattice_lm, packing, prefix_trie, quality, sharding, spm, substring, toxicity

SHARDS = [f"shard-{i:02d}" for i in range(32)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(doc_id, n: int):
    """crc32 of the id as text, modulo n: the contract's train and held-out split."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def piece_model() -> bytes:
    """The public 32k merge vocabulary; 0.5 MB, read once on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def byte_ranks() -> tuple[bytes, str, int]:
    """The public 50k byte-level vocabulary: ranks (0.8 MB), pattern, and the free id that ends a document."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN, 50256


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = bucket_of(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_model(toxicity.labelled(docs.where(~held), labels))
    scored = toxicity.score(docs, *model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = bucket_of(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches are searched; the columns are those of the SQL, all from the exact ones."""
    return op2_near_matches(spark, sf_dir).drop("n_near_items")


def op2_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_decontamination with n_near_items: items matched exactly or by proximity, which SQL does not say."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.digests(decontam.decontaminate(documents(spark, sf_dir), benchmark))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_digests(documents(spark, sf_dir), piece_model())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = bucket_of(F.col("doc_id"), 10) == 0
    scored = lattice_lm.score(docs, docs.where(~held), piece_model())
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir), digest=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]
    return quality.measure(documents(spark, sf_dir)).select(*names)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = bucket_of(F.col("doc_id"), 3) == 1
    model = ftrl.train_model(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ftrl.score(docs, *model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(collocations.collocations(documents(spark, sf_dir)))


def op12_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
rated AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, CAST((CAST(cuts.a AS HUGEINT) * 2000000) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, ws, a, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c)) GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_sql() -> str:
    table = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
    return f"""
WITH crc AS (SELECT {table} AS t),
c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 4 AS h FROM counts, crc),
r AS (SELECT ids.conv_id, pos AS d, role, text FROM ids JOIN c ON c.conv_id = base AND pos <= h
    UNION ALL SELECT ids.conv_id, pos - h + least(h, coalesce(b.n, 0)), role, text FROM ids JOIN c USING (conv_id) LEFT JOIN counts b ON b.conv_id = base WHERE pos > h),
p AS (SELECT conv_id, d, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r
    UNION ALL SELECT conv_id, 0, '', '' FROM ids),
nodes AS (SELECT d, k, min(conv_id) AS rep, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS words FROM p GROUP BY d, k),
up AS (SELECT x.d, x.k, y.k AS pk FROM nodes x JOIN p y ON y.conv_id = x.rep AND y.d = x.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM up GROUP BY ALL),
whole AS (SELECT nodes.*, pk, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN up USING (d, k) LEFT JOIN kids USING (d, k)),
sub AS (SELECT a.d, a.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
    FROM whole f JOIN p a ON a.conv_id = f.rep AND a.d <= f.d GROUP BY a.d, a.k),
ends AS (SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS s FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) USING (conv_id, d) GROUP BY d, k)
SELECT f.rep AS conv_id, CAST(f.d AS BIGINT) AS depth, above.rep AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM whole f JOIN sub USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN nodes above ON above.d = f.d - 1 AND above.k = pk"""


def op2_sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir), *byte_ranks()))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(documents(spark, sf_dir))


def op10_sql() -> str:
    return """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = sa.n AND c = sb.n AS same FROM common JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE c >= 0.8 * (sa.n + sb.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
SELECT doc_id, class_id, least(doc_id, coalesce(m, doc_id)) AS copy_of, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n, min(b) FILTER (WHERE same) AS m FROM links GROUP BY a) USING (doc_id)"""


def op4_sql() -> str:
    table = ", ".join(map(str, sharding.fill_table(SHARDS)))
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, list_extract([{names}], list_extract([{table}], slot + 1) + 1) AS shard FROM placed"""


def op7_sql() -> str:
    return """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def op8_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM split s LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
  NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= 0.1 * n_words
    AND n_stop_words >= 0.005 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op2_near_matches": op2_near_matches,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, Callable[[], str]] = {"op2_decontamination": op2_sql, "op4_sharding": op4_sql, "op7_substring_dedup": op7_sql, "op8_quality_rules": op8_sql, "op10_jaccard_join": op10_sql, "op12_collocations": op12_sql, "op13_prefix_trie": op13_sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in ORACLES.items()}
