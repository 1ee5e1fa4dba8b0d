"""Quality: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

Tokens are the runs of word bytes (letters, digits, everything beyond ASCII) and
the runs of symbols; white space only separates. Features are the runs of 1 to
GRAMS tokens, hashed to FEATURES buckets, and one bucket for all pairs of equal
tokens, whatever these are; a text's row holds 1 + log(count) of each bucket,
scaled to length 1. A score is the logistic function of the sparse
dot product with the weights, plus the intercept.

Fitting takes a bounded sample of the labelled texts: SAMPLE distinct texts at
most, half of them of each label, in the order of a hash of the text, and
SAMPLE_CELLS features in all. Labels meet hashes of the texts, never the texts;
the ids of the sample are the only thing that is broadcast (its size is that of
the sample), so no text is shuffled. The updates run over the sample EPOCHS
times: each coordinate has its own learning rate, L1 leaves rare buckets at 0.

Defined cases: null and empty texts have no features and get the score of the
intercept. Texts of any length are scored whole, in blocks of bounded size.
Labels that are null, or of unknown ids, are not used; of an id that is labelled
twice, the larger label counts. Rows that repeat a doc_id are separate texts with
the label of the id; a repeated text counts once in the sample, and one with both
labels counts for both. A score of exactly 0.5 is label 1. With texts of one
class only, scores are that class's share; without labels (or documents) they are
0.5. An empty table gives no rows. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import kernel as K
from trellis.llm.shared import COUNT_ERROR, blocks, by_batches, discard, hash_limit, materialise, text_bytes

FEATURES = 1 << 18
GRAMS = 2
#: Labelled texts that the updates see, and features of all these together, at most.
SAMPLE = 8000
SAMPLE_CELLS = 8 << 20
EPOCHS = 6
#: Learning rate (alpha, beta) and penalties (L1, L2) of the updates.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 1e-3

#: Bucket (modulo their number) of pairs of equal tokens.
_EQUAL = 0x2F0B4C47

#: 0 for white space, 1 for bytes of words, 2 for symbols.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[K.SPACES] = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens, and for each text the index of its first token (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    some = kind[starts] > 0
    return starts[some], ends[some], np.searchsorted(starts[some], offsets)


def rows_of(column: pa.Array, features: int, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of many texts: buckets and values one text after another, and the n + 1 offsets."""
    data, offsets = text_bytes(column)
    starts, ends, first = tokens(data, offsets)
    words = K.span_hashes(data, starts, ends)
    shift = np.uint64(64 - (features.bit_length() - 1))
    keys = []
    for n in range(1, grams + 1):
        at, text = K.gram_starts(first, n)
        if len(at):
            keys.append(text * features + (K.gram_hashes(words, n)[at] >> shift).astype(np.int64))
            if n == 2:
                twice = words[at] == words[at + 1]
                keys.append(text[twice] * features + _EQUAL % features)
    cells, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    text, values = cells // features, 1 + np.log(counts)
    at = np.searchsorted(text, np.arange(len(column) + 1))
    norms = np.sqrt(np.bincount(text, values**2, len(column)))
    return (cells % features).astype(np.int32), (values / norms[text]).astype(np.float32), at


def picked(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame | None, dict[int, int]]:
    """Which texts are fitted on: key (hash of the text), doc, y, at most ``sample`` rows; and the
    number of labelled texts of each class."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc")).agg((F.max(F.col(label)) > 0).cast("int").alias("y"))
    hashed = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    known = hashed.join(marks.hint("merge"), "doc").withColumn("chosen", F.pmod("key", F.lit(1 << 30)))
    known = materialise(known, "labelled")
    found = known.groupBy("y").agg(F.count("*").alias("n"), F.approx_count_distinct("key", COUNT_ERROR).alias("distinct")).collect()  # two rows
    sizes = {0: 0, 1: 0} | {r["y"]: r["n"] for r in found}
    if not sizes[0] or not sizes[1]:
        discard(known)
        return None, sizes
    limits = {r["y"]: hash_limit(sample // 2, r["distinct"]) for r in found}
    under = known.where(F.col("chosen") < F.when(F.col("y") == 1, limits[1]).otherwise(limits[0]))
    once = under.groupBy("y", "key").agg(F.min("doc").alias("doc"), F.first("chosen").alias("chosen"))
    halves = [once.where(F.col("y") == y).orderBy("chosen", "key").limit(sample // 2) for y in (0, 1)]
    chosen = materialise(halves[0].unionByName(halves[1]).select("key", "doc", "y"), "picked")
    discard(known)
    return chosen, sizes


def updates(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, features: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes of follow-the-regularised-leader updates over the rows as they come."""
    z, n = np.zeros(features + 1), np.zeros(features + 1)  # the last coordinate is the intercept
    l1 = np.full(features + 1, L1)
    l1[-1] = 0.0

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) > l1[at], -(own - np.sign(own) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for (buckets, values), label in zip(rows, y, strict=True):
            at, x = np.append(buckets, features), np.append(values, np.float32(1))
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(features + 1))
    return w[:-1], float(w[-1])


def train_model(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample: int = SAMPLE, cells: int = SAMPLE_CELLS, doc: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """Weights of all buckets and the intercept."""
    chosen, sizes = picked(docs, labels, sample, doc, text, label)
    if chosen is None:
        share = sizes[1] / sum(sizes.values()) if sum(sizes.values()) else 0.5
        return np.zeros(features), float(np.log((share + 1e-3) / (1 - share + 1e-3)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            buckets, values, at = rows_of(batch.column("text"), features)
            parts = [[x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)] for x in (buckets, values)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(np.diff(at)), *(pa.array(p, pa.binary()) for p in parts)], ["key", "y", "size", "buckets", "values"])

    whole = F.coalesce(text, F.lit(""))
    texts = docs.select(F.col(doc).alias("doc"), whole.alias("text"), F.xxhash64(whole).alias("key"))
    # at most `sample` ids are broadcast
    texts = texts.join(F.broadcast(chosen), ["doc", "key"]).select("key", "y", "text").transform(by_batches, sparse, "key long, y int, size long, buckets binary, values binary")
    rows = materialise(texts.dropDuplicates(["key", "y"]), "sparse")
    # the order of the updates: that of the hashes, whatever the tasks were
    order = rows.select("key", "y", "size").toPandas()
    order["rank"] = (order["key"].to_numpy() * np.int64(0x5851F42D4C957F2D)) ^ order["key"].to_numpy()
    order = order.sort_values(["rank", "key", "y"])
    used = order[order["size"].cumsum() <= max(cells, int(order["size"].iloc[0]))]
    wanted = rows.sparkSession.createDataFrame(used[["key", "y"]].astype({"key": "int64", "y": "int32"}), "key long, y int")
    found = rows.join(F.broadcast(wanted), ["key", "y"]).select("key", "y", "buckets", "values").toPandas()
    at = {k: i for i, k in enumerate(zip(used["key"], used["y"], strict=True))}
    found = found.iloc[np.argsort([at[k] for k in zip(found["key"], found["y"], strict=True)])]
    discard(chosen, rows)
    sparse_rows = [(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for b, v in zip(found["buckets"], found["values"], strict=True)]
    return updates(sparse_rows, found["y"].to_numpy(), features)


def score(docs: DataFrame, weights: np.ndarray, intercept: float, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and score (0 to 1) of each text. The weights (1 MB) travel with the function."""
    features = len(weights)
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            buckets, values, at = rows_of(batch.column("text"), features)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            dots = np.bincount(owner, weights[buckets] * values, batch.num_rows) + intercept
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(1 / (1 + np.exp(-np.clip(dots, -500, 500))))], ["doc", "score"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).transform(by_batches, run, f"doc {kind}, score double").withColumnRenamed("doc", doc)
