"""Substring dedup by seed and extend.

A window is ``window`` consecutive words. Every window picks one seed, the
smallest hash among its runs of SEED words (the rightmost of equals: winnowing),
so equal windows pick equal seeds at equal places. The windows that share one
seed occurrence lie side by side; the words they span, the seed extended both
ways as far as its windows reach, are its stretch.

1. Each task finds the seed occurrences of its texts and sends, for each seed,
   (seed, stretch hash, text, first window, number of windows) to the seed's
   bucket. Equal stretches are first merged within a block of texts, so a
   passage that is everywhere costs one entry for each block.
2. A bucket joins the texts on their seeds. Where the whole stretches are equal,
   all windows of a later one are repeats. Of the rest, a seed that stands in one
   stretch only needs nothing more. One that stands in several is open: its match
   ends somewhere within, and the first of each stretch represents it.
3. The texts with open seeds are read again and send each open occurrence with
   the word hashes around it. A bucket joins them on the seed, compares each with
   the earlier ones word by word to the left and to the right of the seed, and
   keeps the windows within the match. A seed with more than ``many`` different
   stretches would need as many comparisons for each: there, single windows are
   sent by their own hashes (128 bits) instead, to buckets of their own, which
   mark all but the first; this is as exact, and no bucket gets such a seed whole.
4. The marks, side by side, are the maximal repeats; they are joined to the
   texts by document, and every word that they cover goes.

The texts themselves are shuffled for steps 3 and 4 only, and no task gets all
occurrences of anything, but one entry (40 bytes) for each block that has it.
The number of buckets follows the bytes of text. Seeds and stretches are
compared by 2 x 64 bits, words by 64.

Defined cases: null and empty texts have no words. "Earlier" is the smaller
doc_id (null comes first), then the earlier start. Ids are integers. Rows with
equal doc_id and equal text are one document read twice: both get its result.
Rows with equal doc_id and other texts are ordered by a hash of the text. An empty
table gives no rows. A text
of any length is handled whole, in memory of some 100 bytes a byte for one block
of 1 MB of text (or one text, if longer). Columns other than the key and the
text are not needed and do not disturb.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm import kernel as K
from trellis.llm.shared import blocks, by_batches, by_groups, materialise, text_bytes

WINDOW = 20
SEED = 8
#: Text of a block within which equal entries are merged, and of a bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
#: Different stretches of one seed that are compared with each other.
MANY = 8

_DUP, _OPEN, _HOT = 1, 2, 3
_MARKS = "doc long, h long, lo int, n int, kind int"
_LOWEST = -(2**63)


def _by_key(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, bool]:
    """doc, h, text: the order of documents is by (doc, h)."""
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(_LOWEST)).alias("doc"), F.col(text).alias("text"))
    counts = rows.select("doc").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("d")).first()
    tell = F.xxhash64("text") if counts["n"] != counts["d"] else F.lit(0).cast("long")
    return rows.withColumn("h", tell), counts["n"] != counts["d"]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends, first = K.word_spans(data, offsets, K.SPACES)
    return K.span_hashes(data, starts, ends), K.span_hashes(data, starts, ends, 1), first


def _stretches(words: np.ndarray, first: np.ndarray, window: int, seed: int):
    """Seed hash, stretch hash, text, first window (in the text), number of windows, and the
    place of the seed (a word index) of each seed occurrence."""
    start, text = K.gram_starts(first, window)
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    grams = K.gram_hashes(words, seed)
    width = window - seed + 1
    picked = start + width - 1 - np.argmin(sliding_window_view(grams, width)[:, ::-1], axis=1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    lo = start[at]
    base = K._LANES[1][2]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * K.powers(base, len(words)), out=sums[1:])
    spans = (sums[lo + n - 1 + window] - sums[lo]) * K.powers(K.inverse(base), len(words) + 1)[lo]
    stretch = K.mix(spans + (n + (picked[at] - lo) * 64).astype(np.uint64))
    return grams[picked[at]], stretch, text[at], lo - first[:-1][text[at]], n, picked[at]


def _marks(doc, h, lo, n, kind) -> pa.RecordBatch:
    """Marks; neighbouring windows of one document are joined up (rows come by document and start)."""
    if len(doc):
        order = np.lexsort((lo, h, doc))
        doc, h, lo, n = doc[order], h[order], lo[order], n[order]
        if kind == _DUP:
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
            heads = np.flatnonzero(new)
            n = np.add.reduceat(n, heads)
            doc, h, lo = doc[heads], h[heads], lo[heads]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(doc), kind, np.int32))], ["doc", "h", "lo", "n", "kind"])


#: Two hashes, then where. Entries travel packed, one value for each block and bucket.
_ENTRY = np.dtype([("a", "u8"), ("b", "u8"), ("doc", "i8"), ("h", "i8"), ("lo", "i4"), ("n", "i4")])
_WHERE = ("doc", "h", "lo", "n")
_SENT = "bucket int, kind int, entries binary"
#: Kinds of packed rows besides marks: entries to be settled by hashes, and by extension.
_PLAIN, _AROUND = 0, 9


def _entries(kind: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(columns["a"]), kind)
    for name, values in columns.items():
        out[name] = values
    return out


def _packed(entries: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries packed into one row for each bucket."""
    if len(entries):
        bucket = (entries["a"] >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        bucket, entries = bucket[order], entries[order]
        heads = np.append(0, np.flatnonzero(np.diff(bucket)) + 1)
        tails = np.append(heads[1:], len(order))
        packed = [entries[i:j].tobytes() for i, j in zip(heads, tails, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), pa.array(np.full(len(heads), kind, np.int32)), pa.array(packed, pa.binary())], ["bucket", "kind", "entries"])


def _unpacked(table: pa.Table, kind: int, of: np.dtype) -> np.ndarray:
    rows = table.filter(pa.compute.equal(table.column("kind"), kind)).column("entries")
    return np.concatenate([np.zeros(0, of), *(np.frombuffer(x.as_buffer(), of) for x in rows)])


def _known(entries: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marks that are known already; any bucket passes them on."""
    if len(entries):
        whole = _marks(*(entries[c] for c in _WHERE), kind)
        where = _entries(_ENTRY, a=np.zeros(whole.num_rows), **{c: whole.column(c).to_numpy() for c in _WHERE})
        yield pa.RecordBatch.from_arrays([pa.array([int(where["doc"][0]) % buckets], pa.int32()), pa.array([kind], pa.int32()), pa.array([where.tobytes()], pa.binary())], ["bucket", "kind", "entries"])


def _first_of(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (a, b, place), and which entries are the first of their (a, b)."""
    order = np.lexsort((e["lo"], e["h"], e["doc"], e["b"], e["a"]))
    a, b = e["a"][order], e["b"][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each entry in its run of equal keys, and the size of the run."""
    heads = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))[: len(sorted_keys)]
    sizes = np.diff(np.append(heads, len(sorted_keys)))
    return np.arange(len(sorted_keys)) - np.repeat(heads, sizes), np.repeat(sizes, sizes)


def _merge_block(e: np.ndarray, buckets: int, by_seed: bool, many: int) -> Iterator[pa.RecordBatch]:
    """Send a block's entries: of equal ones the first, the others are marked at once."""
    order, new = _first_of(e)
    yield from _known(e[order[~new]], _DUP, buckets)
    kept = order[new]
    if by_seed and len(kept):
        rank, size = _groups(e["a"][kept])
        hot = size > many
        # so many of them tell the bucket that the seed stands in more stretches than are compared
        yield from _known(e[kept[hot]], _HOT, buckets)
        kept = kept[~hot | (rank <= many)]
    yield from _packed(e[np.sort(kept)], _PLAIN, buckets)


def _by_blocks(entries_of: Callable, buckets: int, by_seed: bool, many: int, block_bytes: int):
    """A function of Arrow batches: entries of texts, gathered to blocks, merged and sent.
    entries_of also gives rows that are sent as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in blocks(batches, "text"):
            entries, more = entries_of(batch)
            gathered.append(entries)
            yield from more
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield from _merge_block(np.concatenate(gathered), buckets, by_seed, many)
                gathered, size = [], 0
        if gathered:
            yield from _merge_block(np.concatenate(gathered), buckets, by_seed, many)

    return run


def _at(batch: pa.RecordBatch, text: np.ndarray) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy()[text] for c in ("doc", "h")}


def _seed_entries(window: int, seed: int):
    def of(batch: pa.RecordBatch):
        words, _, first = _words(batch.column("text"))
        a, b, text, lo, n, _ = _stretches(words, first, window, seed)
        return _entries(_ENTRY, a=a, b=b, lo=lo, n=n, **_at(batch, text)), ()

    return of


def _around(window: int, seed: int) -> np.dtype:
    """An open occurrence: its seed, where it is, and the word hashes around the seed, which
    starts at column window - seed; ``begin`` is the column of its first window."""
    return np.dtype([("a", "u8"), ("doc", "i8"), ("h", "i8"), ("lo", "i4"), ("n", "i4"), ("begin", "i4"), ("words", "u8", (2 * window - seed,))])


def _open_entries(window: int, seed: int, buckets: int):
    """Entries of single windows for the ranges of hot seeds; for those of open seeds, rows with
    the words around them."""
    side, kind = window - seed, _around(window, seed)

    def of(batch: pa.RecordBatch):
        words, more, first = _words(batch.column("text"))
        ranges = batch.column("ranges")
        flat, owner = ranges.flatten(), np.repeat(np.arange(batch.num_rows), ranges.value_lengths().to_numpy())
        lo, n, what = (flat.field(c).to_numpy() for c in ("lo", "n", "kind"))
        # windows of hot seeds
        edge = np.zeros(len(words) + 2, np.int32)
        hot = what == _HOT
        begin = first[owner] + lo
        np.add.at(edge, begin[hot], 1)
        np.add.at(edge, begin[hot] + n[hot], -1)
        at = np.flatnonzero(np.cumsum(edge) > 0)
        text = np.searchsorted(first, at, side="right") - 1
        single = _entries(_ENTRY, a=K.gram_hashes(words, window)[at], b=K.gram_hashes(more, window, 1)[at], lo=at - first[text], n=1, **_at(batch, text))
        # open seeds
        a, _, text, first_window, count, picked = _stretches(words, first, window, seed)
        opened = np.flatnonzero(np.isin((text << 32) + first_window, (owner.astype(np.int64) << 32)[what == _OPEN] + lo[what == _OPEN]))
        text, picked = text[opened], picked[opened]
        around = _entries(kind, a=a[opened], lo=first_window[opened], n=count[opened], begin=first[text] + first_window[opened] - picked + side, **_at(batch, text))
        padded = np.concatenate([np.zeros(side, np.uint64), words, np.zeros(window, np.uint64)])
        around["words"] = padded[picked[:, None] + np.arange(2 * window - seed)]
        return single, _packed(around, _AROUND, buckets)

    return of


def _extended(e: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Which windows of open occurrences start earlier too: the matches of each occurrence with the
    earlier ones of its seed, extended from the seed to the left and to the right."""
    e = e[np.lexsort((e["lo"], e["h"], e["doc"], e["a"]))]
    rank, size = _groups(e["a"])
    side = window - seed
    columns = np.arange(2 * window - seed)
    own = (columns >= e["begin"][:, None]) & (columns < (e["begin"] + e["n"] + window - 1)[:, None])
    out = [np.zeros(0, _ENTRY)]
    for k in range(1, int(size.max()) if len(size) else 0):
        i = np.flatnonzero(rank >= k)
        for part in np.array_split(i, -(-len(i) // 20_000)):
            same = (e["words"][part] == e["words"][part - k]) & own[part] & own[part - k]
            left = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(1)
            right = np.logical_and.accumulate(same[:, window:], axis=1).sum(1)
            # windows from column side - left to column right, if the seeds are equal word by word
            found = same[:, side:window].all(1) & (side - left <= right)
            some, low = part[found], (side - left)[found]
            out.append(_entries(_ENTRY, a=e["a"][some], doc=e["doc"][some], h=e["h"][some], lo=e["lo"][some] + low - e["begin"][some], n=right[found] - low + 1))
    return np.concatenate(out)


def _settle(by_seed: bool, window: int, seed: int, many: int):
    """The work of a bucket: marks for its entries, besides those that blocks made."""

    def run(table: pa.Table) -> pa.Table:
        e = _unpacked(table, _PLAIN, _ENTRY)
        order, new = _first_of(e)
        out = [(e[order[~new]], _DUP)]
        if by_seed:
            firsts = e[order[new]]
            _, size = _groups(firsts["a"])
            out += [(firsts[(size > 1) & (size <= many)], _OPEN), (firsts[size > many], _HOT)]
        else:
            out.append((_extended(_unpacked(table, _AROUND, _around(window, seed)), window, seed), _DUP))
        out += [(_unpacked(table, kind, _ENTRY), kind) for kind in (_DUP, _HOT)]
        return pa.Table.from_batches([_marks(*(marks[c] for c in _WHERE), kind) for marks, kind in out])

    return run


def _settled(sent: DataFrame, how: Callable, name: str) -> DataFrame:
    return materialise(by_groups(sent.groupBy("bucket"), how, _MARKS), name)


def _ranges(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc", "h").agg(F.collect_list(F.struct("lo", "n", "kind")).alias("ranges"))


def repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, many: int = MANY, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, bool]:
    """doc, h, lo, n: runs of n windows from window lo on, all of which start earlier
    too; and whether h tells rows of one doc apart (otherwise it is 0)."""
    rows, several = _by_key(docs, doc, text)
    if several:  # a row that is read twice is not earlier than itself
        rows = rows.dropDuplicates(["doc", "h"])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    sent = rows.select("doc", "h", "text").transform(by_batches, _by_blocks(_seed_entries(window, seed), buckets, True, many, block_bytes), _SENT)
    marks = _settled(sent, _settle(True, window, seed, many), "seeds")
    wanted = _ranges(marks.where(F.col("kind") != _DUP))
    opened = rows.join(wanted, ["doc", "h"]).select("doc", "h", "text", "ranges")
    sent = opened.transform(by_batches, _by_blocks(_open_entries(window, seed, buckets), buckets, False, many, block_bytes), _SENT)
    ends = _settled(sent, _settle(False, window, seed, many), "ends")
    return marks.where(F.col("kind") == _DUP).unionByName(ends).select("doc", "h", "lo", "n"), several


def _kept_words(text: bytes, ranges: list, window: int) -> tuple[int, list[bytes]]:
    words = text.split()
    if not ranges:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        edge[r["lo"]] += 1
        edge[r["lo"] + r["n"] - 1 + window] -= 1
    return len(words), list(compress(words, np.cumsum(edge[:-1]) == 0))


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, seed: int = SEED, digest: bool = False, **how) -> DataFrame:
    """doc, the columns ``keep`` (but for names of results), n_words, n_removed, and the kept words joined by one
    space: as ``kept`` (the text itself where nothing goes), or with ``digest`` as
    their sha256 (kept_sha256)."""
    keep = tuple(c for c in keep if c not in (doc, "n_words", "n_removed", "kept", "kept_sha256"))
    marks, several = repeats(docs, doc, text, window, seed, **how)
    ranges = marks.distinct().groupBy("doc", "h").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))
    own = docs.select(
        F.coalesce(F.col(doc).cast("long"), F.lit(_LOWEST)).alias("__doc"), (F.xxhash64(text) if several else F.lit(0).cast("long")).alias("__h"),
        F.col(doc), *[F.col(c) for c in keep], F.col(text).alias("__text"),
    )
    joined = own.join(ranges.select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), F.col("ranges").alias("__ranges")), ["__doc", "__h"], "left")
    names = [doc, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__text"):
            counts, removed, out = [], [], []
            for whole, ranges in zip(batch.column("__text").to_pylist(), batch.column("__ranges").to_pylist(), strict=True):
                n, words = _kept_words((whole or "").encode(), ranges, window)
                counts.append(n)
                removed.append(n - len(words))
                if digest:
                    out.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    out.append(whole if len(words) == n else b" ".join(words).decode())
            columns = [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "kept"
    fields = [docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())]
    return joined.select(*names, "__text", "__ranges").transform(by_batches, run, T.StructType(fields))
