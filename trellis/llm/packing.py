"""Token-ID output: sequences of fixed length packed by best fit decreasing.

A document's ids are cut into full rows of ``length`` ids and a remainder
(lossless: the pieces in order are the document). The remainders of a block of
documents are sorted by size, largest first, and each goes to the fullest row
it still fits in. Rows are found by a segment tree over capacities, which knows
for each remaining capacity whether a row has it: the least capacity that is
large enough is found in log2(length) steps.

Blocks are consecutive documents of a task with at most BLOCK_TOKENS ids (or
one document), so memory and time of a task are bounded and rows never cross
tasks. A packed row has its ids (padded to length), the cumulative lengths of
its segments, and positions that start again at 0 with each segment.

Ids come from a public byte-level vocabulary (merge ranks and a pattern, which
travel with the function, 0.8 MB); each document ends with the end id.

Defined cases: null and empty texts have the end id only. A text longer than a
row fills rows of its own, and its remainder is packed; a text of any length is
encoded whole. Of equal remainders the earlier document is placed first; of
equally full rows the one last touched is filled. Rows that repeat a doc_id are
packed as separate segments; a null doc_id stays null. Ids are integers. An
empty table has no rows. Which documents share a row depends on how the input is
partitioned (blocks are those of a task); what a document's ids are does not, and
every partitioning is lossless. Other columns are not needed and do not disturb.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import blocks, by_batches, keeps

LENGTH = 2048
PAD = 0
BLOCK_TOKENS = 1 << 21

SCHEMA = "row_id long, n_tokens int, ids binary, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, positions binary"


class CapacityTree:
    """A segment tree over capacities 0..size: which of them some row has left."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the least capacity >= need, taken out; None if there is none."""
        some, node = self.some, self.leaves + need
        if not some[node]:  # up until a right sibling has something, then down on its left
            while node > 1 and (node & 1 or not some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            while node and not (node < self.leaves and (some[2 * node] or some[2 * node + 1])):
                some[node] = 0
                node >>= 1
        return capacity, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows as lists of indices into sizes (each from 1 to length)."""
    tree, rows = CapacityTree(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found:
            capacity, row = found
            rows[row].append(i)
        else:
            capacity, row = length, len(rows)
            rows.append([i])
        if capacity > size:
            tree.add(capacity - size, row)
    return rows


def pack_block(docs: list, ids: list[np.ndarray], length: int):
    """Rows of a block: lists of (document, first id, ids)."""
    full, rest = [], []
    for doc, own in zip(docs, ids, strict=True):
        cut = len(own) - len(own) % length
        full += [[(doc, i, own[i : i + length])] for i in range(0, cut, length)]
        if cut < len(own):
            rest.append((doc, cut, own[cut:]))
    rows = best_fit_decreasing(np.array([len(r[2]) for r in rest], np.int64), length)
    return full + [[rest[i] for i in row] for row in rows]


def _batch_of(rows, first: int, length: int) -> pa.RecordBatch:
    columns = {c: [] for c in ("n_tokens", "ids", "doc_ids", "starts", "cu_seqlens", "positions")}
    for row in rows:
        sizes = [len(s[2]) for s in row]
        total = sum(sizes)
        line = np.full(length, PAD, "<i4")
        line[:total] = np.concatenate([s[2] for s in row])
        positions = np.zeros(length, "<i4")
        positions[:total] = np.concatenate([np.arange(n) for n in sizes])
        for c, v in zip(columns, (total, line.tobytes(), [s[0] for s in row], [s[1] for s in row], np.cumsum([0, *sizes]).tolist(), positions.tobytes()), strict=True):
            columns[c].append(v)
    types = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), *(pa.array(v, t) for v, t in zip(columns.values(), types, strict=True))], ["row_id", *columns])


_ENCODERS: dict[str, object] = {}
keeps("packing", _ENCODERS.clear)


def encoder_for(ranks: bytes, pattern: str):
    """This worker's encoder for lines of (base64 token, rank) and a splitting pattern."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def pack(docs: DataFrame, ranks: bytes, pattern: str, end: int, doc: str = "doc_id", text: str = "text", length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows (SCHEMA): ids and positions are matrices' lines, little-endian 32-bit
    integers; segment k of a row is ids[cu_seqlens[k]:cu_seqlens[k + 1]], from id
    starts[k] of document doc_ids[k] on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(ranks, pattern).encode_ordinary
        row = TaskContext.get().partitionId() << 40
        names, ids, size = [], [], 0

        def flush():
            nonlocal row, names, ids, size
            rows = pack_block(names, ids, length)
            for i in range(0, len(rows), 256):
                yield _batch_of(rows[i : i + 256], row + i, length)
            row += len(rows)
            names, ids, size = [], [], 0

        for batch in blocks(batches, "text", 1 << 20):
            for name, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.array([*encode(text or ""), end], "<i4")
                if size and size + len(own) > block_tokens:
                    yield from flush()
                names.append(name)
                ids.append(own)
                size += len(own)
        if names:
            yield from flush()

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).transform(by_batches, run, SCHEMA, "packing")


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, a file for each task; ids and positions read back as id matrices."""
    packed.write.mode("overwrite").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """The rows with digests in place of the matrices' lines."""
    return packed.select("row_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))

