"""Benchmark decontamination by a distributed positional inverted index.

1. The training texts are read once and stored as an index. Texts stand in blocks of BLOCK_BYTES;
   for each block and term (a 64-bit hash of a word) there is one posting list: the positions of
   the term in the block, as differences of 16 bits. The table is partitioned by a bucket of the
   term, and within it lies by ranges of blocks and by term, so a hot term is many lists of bounded
   size, and a lookup reads only the buckets and (by the statistics of its files) terms it asks
   for. One row for each text tells where it starts. The index serves any number of test sets;
   looking one up reads no text.
2. Windows of the test items are their runs of ``window`` words (a shorter item is one window).
   Items are cut into pieces of PIECE windows, which overlap so that no window is lost, and pieces
   are dealt to rounds of at most ``limit`` windows. What a round collects and sends to the tasks
   (12 bytes for each of its terms, 24 for each anchor) is bounded however many or long items are.
3. The lengths of the posting lists tell how often each test term occurs. A window with a term that
   never occurs cannot match exactly; each other window is looked up by its rarest terms, its
   anchors. With ``slack``, a window may miss as many terms as ``near_share`` leaves free: those
   that never occur are some of these, and anchors are one term more than the rest of them, so one
   stands in any match.
4. Blocks in which an anchor occurs give the posting lists of the round's terms. Each position of an
   anchor is adjusted by the anchor's offset in its piece: an alignment. Those around which no window
   has enough of its terms, wherever they stand, are left out; for the others the lists are
   intersected at the alignment. Runs that cover a whole window are exact phrase matches. With
   ``slack``, terms may stand that many words off: a window with ``near_share`` of its terms in
   place, for one shift of the window, is a proximity match. All shifts at which an anchor may
   stand that far off are tried.

A task holds the lists of one block; a very common test passage gives one row for each text that
has it.

Defined cases: null or empty texts and items have no words, hence no matches, and the digest of an
empty list; a text as long as memory allows is indexed whole, as a block of its own. Of terms that
are equally rare, the one with the smaller hash and then the first in the window is the anchor. Rows
that repeat a doc_id, or have none, are separate texts. Rows that repeat an item_id count as one
item. Items without an item_id are one item, named null (the first of a list): their spans and they
themselves count, and digests of lists leave out the name, as the SQL does. Empty tables give no
rows, or clean ones. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm import kernel as K
from trellis.llm.shared import blocks, by_batches, by_groups, discard, materialise, text_bytes

WINDOW = 10
SLACK = 2
NEAR_SHARE = 0.8
#: Windows of a round, and of a piece of an item.
MAX_WINDOWS = 500_000
PIECE = 1000
#: Rarest terms by which a window is looked up, at least: one finds every exact
#: match; proximity takes as many as may be missing, and one more.
ANCHORS = 2
#: Item terms checked at once, and places of anchors.
STEP = 100_000
CANDIDATES = 20_000
#: Text of a block and texts in it; buckets of terms (a power of two); text that one task writes lists of.
BLOCK_BYTES = 8 << 20
BLOCK_TEXTS = 1 << 16
BUCKETS = 64
PART_BYTES = 64 << 20
_SKIP = 65535


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the index of each row's first word."""
    data, offsets = text_bytes(column)
    data = K.LOWER[data]
    starts, ends, first = K.word_spans(data, offsets, K.NOT_ALNUM)
    return K.span_hashes(data, starts, ends), first


def _index_in(terms: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Index of each term in the sorted vocabulary, or -1."""
    if not len(vocabulary):
        return np.full(len(terms), -1)
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == terms, at, -1)


# ---- the index --------------------------------------------------------------------------------


def packed(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists of a block's words: the terms, their numbers of postings, 16-bit values, and the
    offsets of each term's values. A value is the difference to the position before; SKIP adds to the
    next one without being a posting."""
    order = np.argsort(terms, kind="stable")
    ordered = terms[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    step = np.diff(order, prepend=0)
    step[heads] = order[heads]
    skips = step // _SKIP
    ends = np.cumsum(skips + 1)
    values = np.full(int(ends[-1]) if len(ends) else 0, _SKIP, np.uint16)
    values[ends - 1] = step - skips * _SKIP
    at = np.append(ends[heads] - skips[heads] - 1, len(values))
    return ordered[heads], np.diff(np.append(heads, len(order))), values, at


def unpacked(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all lists one after another, and how many each list has."""
    parts = [np.frombuffer(x.as_buffer(), np.uint16) for x in lists]
    sizes = np.array([len(p) for p in parts], np.int64)
    values = np.concatenate([np.zeros(0, np.uint16), *parts])
    real = values != _SKIP
    sums = np.cumsum(values, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    base = np.append(0, sums)[starts]
    of = np.repeat(np.arange(len(parts)), sizes)
    return (sums - base[of])[real], np.bincount(of[real], minlength=len(parts))


class Index:
    """A stored index: ``postings`` (bucket, term, block, n, at) and ``texts`` (block, row, doc, n_words, first)."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.postings = table.where("bucket >= 0").select("bucket", "term", "block", "n", "at")
        self.texts = table.where("bucket = -1").select("block", "row", "doc", "n_words", "first")


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    """Read the texts once and store their postings in the shared folder."""
    kind = docs.schema[doc].dataType
    names = ["bucket", "block", "term", "n", "at", "row", "doc", "n_words", "first"]

    def stored(terms: np.ndarray, counts: list[int], doc_ids: list[pa.Array], row: int) -> Iterator[pa.RecordBatch]:
        doc_ids = pa.concat_arrays(doc_ids)
        found, n, values, at = packed(terms)
        lists = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(values)])
        none = lambda k, t: pa.nulls(k, t)
        bucket = (found >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int32)
        k = len(found)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(k, row)), pa.array(K.signed(found)), pa.array(n.astype(np.int32)), lists, none(k, pa.int64()), none(k, doc_ids.type), none(k, pa.int64()), none(k, pa.int32())], names)
        k, words = len(counts), np.array(counts, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, -1, np.int32)), pa.array(np.full(k, row)), none(k, pa.int64()), none(k, pa.int32()), none(k, pa.binary()), pa.array(np.arange(row, row + k)), doc_ids, pa.array(words), pa.array((np.cumsum(words) - words).astype(np.int32))],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        words, counts, ids, size = [], [], [], 0
        for batch in blocks(batches, "text"):
            terms, first = _terms(batch.column("text"))
            if counts and (size + batch.column("text").nbytes > block_bytes or len(counts) + batch.num_rows > BLOCK_TEXTS):
                yield from stored(np.concatenate(words), counts, ids, row)
                row += len(counts)
                words, counts, ids, size = [], [], [], 0
            words.append(terms)
            counts += np.diff(first).tolist()
            ids.append(batch.column("doc"))
            size += batch.column("text").nbytes
        if counts:
            yield from stored(np.concatenate(words), counts, ids, row)

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = rows.transform(by_batches, run, f"bucket int, block long, term long, n int, at binary, row long, doc {kind.simpleString()}, n_words long, first int")
    # a task writes the lists of one bucket for a range of blocks
    ranges = max(1, size // (PART_BYTES * BUCKETS))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges * BUCKETS)
    dealt = found.repartition(parts, "bucket", F.pmod(F.xxhash64("block"), F.lit(ranges))).sortWithinPartitions("bucket", "term")
    return Index(materialise(dealt, "index", "bucket"))


# ---- test items -------------------------------------------------------------------------------


def items(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """key, item (string), n (windows) and terms array<long>: the pieces of items with words, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            terms, first = _terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(K.signed(terms)))], ["item", "terms"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    whole = rows.transform(by_batches, run, "item string, terms array<long>").where("size(terms) > 0")
    begins = F.sequence(F.lit(0), F.greatest(F.size("terms") - window, F.lit(0)), F.lit(PIECE))
    cut = whole.select("item", "terms", F.explode(begins).alias("begin")).select("item", F.slice("terms", F.col("begin") + 1, PIECE + window - 1).alias("terms")).distinct()
    return materialise(cut.select(F.monotonically_increasing_id().alias("key"), "item", F.greatest(F.size("terms") - window + 1, F.lit(1)).alias("n"), "terms"), "items")


def rounds(pieces: DataFrame, limit: int) -> list[DataFrame]:
    """The pieces, dealt to rounds of some half of ``limit`` windows; only rounds that have any."""
    n = pieces.agg(F.sum("n")).first()[0] or 0
    if n <= limit:
        return [pieces] * (n > 0)
    part = F.pmod(F.xxhash64("key"), F.lit(-(-2 * n // limit)))
    return [pieces.where(part == k) for (k,) in sorted(pieces.select(part).distinct().collect())]


def anchors(pieces: DataFrame, counts: DataFrame, window: int = WINDOW, per_window: int = ANCHORS, near_share: float = 1.0) -> DataFrame:
    """key, at (offset in the piece), term: the rarest terms that occur, of each window of
    whose terms a share of near_share occurs."""
    size = F.least(F.size("terms"), F.lit(window))
    windows = pieces.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("terms") - size)))
    words = windows.select("key", "start", F.posexplode(F.slice("terms", F.col("start") + 1, size)).alias("k", "term"))
    # the counts are those of one round's terms, a table whose size ``limit`` bounds
    rated = words.join(F.broadcast(counts), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("key", "start").agg(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "term", "k")))).alias("by_n"), F.count("*").alias("size"))
    spare = F.size("by_n") - F.ceil(F.lit(near_share) * F.col("size"))  # terms that occur and may be missing
    picked = rarest.where(spare >= 0).select("key", "start", F.explode(F.slice("by_n", F.lit(1), F.greatest(F.lit(per_window), spare + 1).cast("int"))).alias("r"))
    return picked.select("key", (F.col("start") + F.col("r.k")).alias("at"), F.col("r.term").alias("term")).distinct()


class _Round:
    """What tasks know of a round: the sorted terms (vocabulary), the pieces' terms as indexes of it, one
    piece after another from ``first`` on, and by term k the anchors starts[k] to starts[k + 1]: ``piece``
    and offset ``at`` in it."""

    def __init__(self, pieces: DataFrame, anchor_rows: DataFrame, vocabulary: np.ndarray):
        whole = pieces.select("key", "terms").toArrow().combine_chunks()
        flat, self.first = _flat(whole.column("terms").combine_chunks())
        self.keys, self.vocabulary = whole.column("key").to_numpy(), vocabulary
        self.codes = _index_in(flat.view(np.uint64), vocabulary).astype(np.int32)
        rows = anchor_rows.select("key", "at", "term").toPandas()
        by_key = np.argsort(self.keys)
        term = _index_in(rows["term"].to_numpy().view(np.uint64), vocabulary)
        order = np.argsort(term, kind="stable")
        self.starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.piece = by_key[np.searchsorted(self.keys[by_key], rows["key"].to_numpy())][order]
        self.at = rows["at"].to_numpy()[order].astype(np.int64)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the n + 1 offsets."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---- lookup -----------------------------------------------------------------------------------


def _alignments(words: np.ndarray, base: np.ndarray, hits: np.ndarray, owner: np.ndarray, what: _Round, window: int, slack: int, near_share: float):
    """Text, piece and shift of the alignments around which enough terms of a window stand, within
    2 * slack of the shift. ``words`` has the texts' words (codes, -1 elsewhere) from ``base`` on."""
    codes = words[hits]
    begin, count = what.starts[codes], what.starts[codes + 1] - what.starts[codes]
    ends = np.cumsum(count)
    around, wider = np.arange(1 - window, window), np.arange(1 - window - 2 * slack, window + 2 * slack)
    sizes = np.diff(what.first)
    out = [np.zeros((0, 3), np.int64)]
    for low in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
        entry = np.arange(low, min(low + CANDIDATES, ends[-1]))
        hit = np.searchsorted(ends, entry, side="right")
        place = begin[hit] + entry - (ends[hit] - count[hit])
        piece, at = what.piece[place], what.at[place]
        near = at[:, None] + around
        inside = (near >= 0) & (near < sizes[piece][:, None])
        want = np.where(inside, what.codes[np.where(inside, what.first[piece][:, None] + near, 0)], -2)
        text = words[hits[hit][:, None] + wider]
        there = np.zeros(want.shape, bool)
        for moved in range(4 * slack + 1):
            there |= text[:, moved : moved + len(around)] == want
        sums = np.cumsum(np.pad(there, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        some = (sums[:, window:] - sums[:, :window]).max(axis=1) >= near_share * np.minimum(sizes[piece], window)
        out.append(np.stack([owner[hit], piece, hits[hit] - base[owner[hit]] - at], axis=1)[some])
    return np.unique(np.concatenate(out), axis=0).T


def _aligned(words: np.ndarray, base: np.ndarray, n_words: np.ndarray, text: np.ndarray, piece: np.ndarray, shift: np.ndarray, what: _Round, window: int, slack: int, near_share: float):
    """What some alignments match: of each that matches its index, whether it is a proximity match,
    and its spans (index, from, to)."""
    sizes = np.diff(what.first)[piece]
    owner = np.repeat(np.arange(len(text)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item = what.codes[what.first[piece][owner] + offset]
    place = shift[owner] + offset

    def at_off(off: int) -> np.ndarray:
        inside = (place + off >= 0) & (place + off < n_words[text][owner])
        return inside & (words[np.where(inside, base[text][owner] + place + off, 0)] == item) & (item >= 0)

    stands = {off: at_off(off) for off in range(-2 * slack, 2 * slack + 1)}
    length = np.minimum(sizes, window)
    here = np.flatnonzero(offset <= (sizes - length)[owner])  # a window starts here
    long = length[owner[here]]
    sums = np.concatenate([[0], np.cumsum(stands[0])])
    full = here[sums[here + long] - sums[here] == long]
    near = np.zeros(len(text), bool)
    for moved in range(-slack, slack + 1):  # the anchor itself may stand off
        by = np.any([stands[moved + off] for off in range(-slack, slack + 1)], axis=0)
        near_sums = np.concatenate([[0], np.cumsum(by)])
        near[owner[here[near_sums[here + long] - near_sums[here] >= near_share * long]]] = True
    # runs of exact windows become spans
    start, of = place[full], owner[full]
    new = np.ones(len(full), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > start[:-1] + length[of][:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(full))[: len(heads)] - 1
    return near, of[heads], start[heads], start[tails] + length[of[tails]]


def _in_block(what: _Round, window: int, slack: int, near_share: float):
    """The work of a block: its posting lists of the round's terms, and where its texts start."""
    pad = window + 2 * slack

    def run(table: pa.Table) -> pa.Table:
        texts = table.filter(pa.compute.is_valid(table.column("row"))).sort_by("row")
        lists = table.filter(pa.compute.is_null(table.column("row")))
        row, n_words, first = (texts.column(c).to_numpy() for c in ("row", "n_words", "first"))
        base = first + pad * np.arange(1, len(first) + 1)
        words = np.full(int(n_words.sum()) + pad * (len(first) + 1), -1, np.int32)
        at, counts = unpacked(lists.column("at"))
        codes = np.repeat(_index_in(lists.column("term").to_numpy().view(np.uint64), what.vocabulary), counts)
        owner = np.searchsorted(first, at, side="right") - 1
        words[at + pad * (owner + 1)] = codes
        is_anchor = np.diff(what.starts) > 0
        order = np.argsort(at[hit]) if len(hit := np.flatnonzero(is_anchor[codes])) else hit
        hit = hit[order]
        text, piece, shift = _alignments(words, base, at[hit] + pad * (owner[hit] + 1), owner[hit], what, window, slack, near_share)
        ends = np.cumsum(np.diff(what.first)[piece]) if len(piece) else np.zeros(0, np.int64)
        out = {c: [np.zeros(0, np.int64)] for c in ("row", "key", "from", "to")}
        begin = 0
        while begin < len(text):  # alignments with STEP item terms at most, or one
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP, side="right")))
            near, of, low, high = _aligned(words, base, n_words, text[begin:end], piece[begin:end], shift[begin:end], what, window, slack, near_share)
            close = np.flatnonzero(near)
            for c, exact, nearly in (("row", row[text[begin:end][of]], row[text[begin:end][close]]), ("key", what.keys[piece[begin:end][of]], what.keys[piece[begin:end][close]]), ("from", low, np.full(len(close), -1)), ("to", high, np.full(len(close), -1))):
                out[c] += [exact, nearly]
            begin = end
        found = np.unique(np.stack([np.concatenate(v).astype(np.int64) for v in out.values()], axis=1), axis=0).T
        return pa.table(dict(zip(out, map(pa.array, found), strict=True)))

    return run


def lookup(index: Index, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK, near_share: float = NEAR_SHARE, limit: int = MAX_WINDOWS, per_window: int = ANCHORS) -> DataFrame:
    """row, item, from, to (word positions of an exact match in the text, from -1 to -1 for a
    proximity match) as a table. Reads the index only."""
    near_share = near_share if slack else 1.0
    pieces = items(benchmark, window)
    spark = pieces.sparkSession
    used, found = [pieces], None
    for part in rounds(pieces, limit):
        terms = part.select(F.explode("terms").alias("term")).distinct()
        vocabulary = np.unique(np.array(terms.toPandas()["term"], np.int64).view(np.uint64))
        buckets = np.unique(vocabulary >> np.uint64(65 - BUCKETS.bit_length())).astype(int).tolist()
        known = spark.createDataFrame(pa.table({"term": pa.array(K.signed(vocabulary))}))  # a round's terms
        lists = index.postings.where(F.col("bucket").isin(buckets)).join(F.broadcast(known), "term", "left_semi")
        counts = materialise(lists.groupBy("term").agg(F.sum("n").alias("n")), "counts")
        anchor_rows = materialise(anchors(part, counts, window, per_window, near_share), "anchors")
        what = spark.sparkContext.broadcast(_Round(part, anchor_rows, vocabulary))
        there = lists.join(F.broadcast(anchor_rows.select("term").distinct()), "term", "left_semi").select("block").distinct()
        texts = index.texts.select("block", F.lit(None).cast("long").alias("term"), F.lit(None).cast("binary").alias("at"), "row", "n_words", "first")
        rows = lists.select("block", "term", "at", *[F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("n_words", "long"), ("first", "int"))]).unionByName(texts).join(there, "block", "left_semi")
        hit = materialise(by_groups(rows.groupBy("block"), lambda table, what=what: _in_block(what.value, window, slack, near_share)(table), "row long, key long, from long, to long"), "hits")
        used += [counts, anchor_rows, hit]
        found = hit if found is None else found.unionByName(hit)
    if found is None:  # no item has a word
        found = spark.createDataFrame([], "row long, key long, from long, to long")
    out = materialise(found.join(pieces.select("key", "item"), "key").select("row", "item", "from", "to").distinct(), "matches")
    discard(*used)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """For each text: doc, n_words, n_hit, items (sorted strings, exact), near_items
    (sorted strings, exact or by proximity)."""
    index = build_index(docs, doc, text, block_bytes)
    matches = lookup(index, benchmark, **how)
    texts = materialise(index.texts.select("row", "doc", "n_words"), "texts")
    discard(index.table)
    return summaries(texts, matches).withColumnRenamed("doc", doc)


def summaries(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """doc, n_words, n_hit, items and near_items of all texts (row, doc, n_words), from the matches."""
    by_item = matches.groupBy("row", "item").agg(F.max(F.col("from") >= 0).alias("exact"))
    both = by_item.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item", "exact"))).alias("found"))  # structs: null names stay
    item_lists = both.select("row", F.transform(F.filter("found", lambda x: x["exact"]), lambda x: x["item"]).alias("items"), F.col("found.item").alias("near_items"))
    spans = matches.where("from >= 0").select("row", "from", "to").distinct()
    before = Window.partitionBy("row").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("to") - F.greatest(F.col("from"), F.coalesce(F.max("to").over(before), F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    empty = F.array().cast("array<string>")
    whole = texts.join(item_lists, "row", "left").join(hits, "row", "left")
    return whole.select("doc", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", empty).alias("items"), F.coalesce("near_items", empty).alias("near_items"))


def digests(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """n_items, items_sha256 and contaminated from the lists."""
    return df.select(doc, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))
