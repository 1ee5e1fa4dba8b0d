"""Collocations of words, mined level by level with hashed bucket counts (PCY / DHP) and Apriori pruning.

Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line breaks; a phrase is
a run of words within a piece. All counts are of one language (null: ``und``).

Pass k reads the texts once. It counts exactly the phrases of k words that can be frequent, and
meanwhile hashes the phrases of k + 1 words whose two parts of k words can be frequent into
buckets that it counts too. From both follow two bitmaps for the next pass: buckets with at
least ``floor`` occurrences, and hashes of the phrases that turned out frequent. A phrase of
k + 1 words is then counted only if its bucket's bit is set and both of its parts of k words have
their bit in the second bitmap (Apriori). Neither bitmap has false negatives, so the counts of
frequent phrases are exact; words are compared as they are, never by hash.

What is broadcast is these two bitmaps of ``bits`` bits each: a power of two near a sixteenth of
the bytes of text, between LEAST_BITS and MOST_BITS (64 MB). From some 100 GB of text on every
bucket fills up and only Apriori prunes, which costs time and changes no result. Counts are
added up within a block of text (buckets within some blocks), then in each task by Spark, then by key: a phrase or bucket that
is everywhere gives one row a task. Ranking is done by a hash of the phrase first, so no task
ever sorts all phrases of a language.

Defined cases: null and empty texts and texts without words count nothing; a language without
frequent phrases has no rows; an empty table gives an empty result. A null language is counted
with ``und``. Repeated rows count each time. A text of any length is read whole, as one block.
Ties of scores go to the greater count, then to the phrase that is less by its bytes. Columns
other than the two that are named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm import kernel as K
from trellis.llm.shared import blocks, by_batches, discard, materialise, text_bytes

FLOOR = 30
LONGEST = 4
COVER = 80
TOP = 2000
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Text of one block, buckets that a task counts before it sends them, and hash groups of the
#: three steps of ranking.
BLOCK_BYTES = 1 << 19
CELLS = 1 << 19
STEPS = (4096, 64, 1)

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _SEPARATORS.copy()
_GAPS[[0x20, 0x09]] = True
_ROWS = "lang string, phrase string, cell long, n long"


class _Block:
    """Words of a block of texts: ``word`` is an index into ``names`` (exact), ``key`` an index of
    (lang, word), ``run`` how many words of the piece follow from here on (itself included)."""

    def __init__(self, batch: pa.RecordBatch, bits: int):
        data, offsets = text_bytes(batch.column("text"))
        data = K.LOWER[data]
        starts, ends, first = K.word_spans(data, offsets, _GAPS)
        n = len(starts)
        at = np.zeros(n + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        letters = np.ascontiguousarray(data[~_GAPS[data]])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        self.names, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        langs = batch.column("lang").dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)[text]
        self.key = self.lang * len(self.names) + self.word
        piece = np.cumsum(_SEPARATORS[data])[starts] if n else np.zeros(0, np.int64)
        last = np.ones(n, bool)
        last[:-1] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        stops = np.flatnonzero(last) + 1
        self.run = (stops[np.searchsorted(stops, np.arange(n), side="right")] - np.arange(n)) if n else np.zeros(0, np.int64)
        lang_data, lang_at = text_bytes(batch.column("lang"))
        self._seed = K.span_hashes(lang_data, lang_at[:-1], lang_at[1:])[text]
        self._hashes = K.span_hashes(data, starts, ends)
        self._shift = np.uint64(64 - (bits.bit_length() - 1))

    def cells(self, k: int) -> np.ndarray:
        """Bucket of the k words from each place on (of places where so many are left in the block)."""
        grams = K.gram_hashes(self._hashes, k)
        return (K.mix(grams ^ self._seed[: len(grams)]) >> self._shift).astype(np.int64)

    def counted(self, places: np.ndarray, k: int) -> list[pa.Array]:
        """Columns of _ROWS: the phrases of k words at these places, each once with its count."""
        code, firsts = self.key[places], np.arange(len(places))
        for i in range(k):
            if i:
                code = code * len(self.names) + self.word[places + i]
            _, firsts, code, counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        at = places[firsts]
        words = [self.names.take(pa.array(self.word[at + i])) for i in range(k)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]
        return [self.langs.take(pa.array(self.lang[at])), phrase.cast(pa.binary()).cast(pa.string()), pa.array(self.cells(k)[at]), pa.array(counts.astype(np.int64))]


def _set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0


def _pass(k: int, longest: int, bits: int, maps):
    """Rows of a pass: phrases of k words; with phrase null, buckets of k + 1 words (lang null too)
    and, in the first pass, the number of words of each language."""

    def sent(cells, counts):
        none = pa.nulls(len(cells), pa.string())
        return pa.RecordBatch.from_arrays([none, none, pa.array(cells), pa.array(counts)], names=["lang", "phrase", "cell", "n"])

    def added(some):
        """Buckets once each, with the sums of their counts."""
        cells, at = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
        return cells, np.bincount(at, np.concatenate([n for _, n in some]), len(cells)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        bucket_map, part_map = (np.frombuffer(x, np.uint8) for x in maps.value) if maps else (None, None)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            block = _Block(batch, bits)
            n = len(block.run)
            can = np.zeros(n + 1, bool)  # a phrase of k words stands here that can be frequent
            can[:n] = block.run >= k
            if maps and n >= k:
                parts = _set(part_map, block.cells(k - 1))
                here = np.flatnonzero(can)
                can[here] = parts[here] & parts[here + 1] & _set(bucket_map, block.cells(k)[here])
            places = np.flatnonzero(can)
            if len(places):
                yield pa.RecordBatch.from_arrays(block.counted(places, k), names=["lang", "phrase", "cell", "n"])
            if k < longest and n > k:
                longer = np.flatnonzero(can[:-1] & can[1:] & (block.run > k))
                kept.append(np.unique(block.cells(k + 1)[longer], return_counts=True))
                if sum(len(c) for c, _ in kept) > CELLS:
                    kept = [added(kept)]
                    if len(kept[0][0]) > CELLS // 2:
                        yield sent(*kept.pop())
            if k == 1 and n:
                totals = np.bincount(block.lang, minlength=len(block.langs))
                yield pa.RecordBatch.from_arrays([block.langs, pa.nulls(len(totals), pa.string()), pa.array(np.full(len(totals), -1)), pa.array(totals.astype(np.int64))], names=["lang", "phrase", "cell", "n"])
        if kept:
            yield sent(*added(kept))

    return run


def bitmap(cells: DataFrame, bits: int) -> bytes:
    """The bits of the column ``cell``, bits / 8 bytes: the least bit of a byte comes first."""
    out = np.zeros(bits // 8, np.uint8)
    at = F.col("cell") + 1  # bits of a slice count from 1
    parts = cells.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    for row in parts.collect():  # bits / 32768 rows at most
        begin = (row["part"] - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)[: bits // 8 - begin]
    return out.tobytes()


def frequent(docs: DataFrame, lang: str = "lang", text: str = "text", floor: int = FLOOR, longest: int = LONGEST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a): the phrases of 1 to ``longest`` words with a >= floor occurrences; and
    (lang, n): the words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (size // 16).bit_length()))
    maps, found, totals = None, None, None
    for k in range(1, longest + 1):
        counts = rows.transform(by_batches, _pass(k, longest, bits, maps), _ROWS).groupBy("lang", "phrase", "cell").agg(F.sum("n").alias("n"))
        level = materialise(counts.where((F.col("n") >= floor) | (F.col("cell") < 0)), f"phrases{k}")
        if k == 1:
            totals = level.where("cell < 0").select("lang", "n")
        exact = level.where("phrase IS NOT NULL")
        own = exact.select("lang", "phrase", F.col("n").alias("a"))
        found = own if found is None else found.unionByName(own)
        if k < longest:
            if maps:
                maps.unpersist()
            maps = spark.sparkContext.broadcast((bitmap(level.where("lang IS NULL"), bits), bitmap(exact, bits)))
    return found, totals


def _joined(words, begin, size):
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", floor: int = FLOOR, longest: int = LONGEST, cover: int = COVER, bits: int | None = None) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer candidate covers.

    score = floor(2000000 * a / (l + r)) at the cut with the lowest one, the earliest of equals."""
    counts, totals = frequent(docs, lang, text, floor, longest, bits)
    whole = counts.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words")).where("k > 1")
    cuts = whole.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "j", _joined("words", F.lit(1), F.col("j")).alias("left"), _joined("words", F.col("j") + 1, F.col("k") - F.col("j")).alias("right"))
    # both parts of a frequent phrase are frequent, so both have their counts
    left, right = (counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(n)) for side, n in (("left", "l"), ("right", "r")))
    rated = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # 2,000,000 * a may pass 64 bits; the quotient is at most 1,000,000
    score = F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    rated = rated.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("cut"))
    # (begin, size) of all shorter phrases within a longer one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda begin: _joined("words", begin, size))))
    covers = whole.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"longer IS NOT NULL AND cast(longer AS decimal(20, 0)) * 100 >= cast(a AS decimal(20, 0)) * {int(cover)}")
    kept = rated.join(covers, ["lang", "phrase"], "left").where(~covered)
    return kept.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def top(found: DataFrame, limit: int = TOP) -> DataFrame:
    """The first ``limit`` of each language by score and count, descending, then phrase; with rank, from 1."""
    for groups in STEPS:
        order = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
