"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (1 to 4 code points of the
letters, lower-cased, words between blanks) that occur in both, over the
geometric mean of each text's own number: a blended-spectrum presence kernel.
N-grams are told apart by 64-bit hashes, so a long text does not come to look
like every other. Texts count whole, from first to last character.

Nystroem: LANDMARKS pieces of training texts at most (a bounded sample: as many distinct
texts for each language, by a hash of the text, one of each of the most frequent
languages where there are more languages than landmarks; and of each a piece of
LANDMARK_CHARS characters at most, at a place chosen by the hash) span the
feature space; a text's features are its kernels with them times the inverse
root of the landmarks' own kernel matrix. Only the landmarks' n-grams have a
part in a kernel, so a text is a row of presence over this bounded vocabulary,
and its number of n-grams. One-versus-rest kernel ridge regression over ALL
training texts needs two sums over them, of outer products of features with
themselves and with the targets; tasks send one matrix each, added up in Spark
some tasks at a time. Texts are scored in batches by two matrix products.

Defined cases: a text that is null or has no letter is ``und`` with score 0.
Ties go to the first language in alphabetical order. A language whose texts all
lack letters is not learned; of more than LANGS languages (a column of dirty values)
the most frequent are. An empty table gives no rows. Without training texts everything is ``und``. Texts
of any length are used whole; of texts that are repeated one can be a landmark,
all count in the sums. Other columns are not needed and do not disturb.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.shared import COUNT_ERROR, blocks, by_batches, discard, hash_limit, materialise, tree_sum

GRAMS = 4
LANDMARKS = 128
LANDMARK_CHARS = 2000
#: Languages that are learned, at most: the most frequent ones.
LANGS = 1000
RIDGE = 1e-3
#: Texts in a matrix product, and slices of a task's sums, which are added up apart.
BATCH, SLICES = 64, 16
UNKNOWN = "und"

_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of anything but letters as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 128) & _is_alpha(codes))
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others stays, as a blank
    return np.concatenate([[32], np.where(is_letter, codes, 32)[keep], [32]]).astype(np.uint32)


_ALPHA: dict[int, bool] = {}


def _is_alpha(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), bool)
    where = np.flatnonzero(codes >= 128)
    if len(where):
        distinct, back = np.unique(codes[where], return_inverse=True)
        for c in distinct.tolist():
            if c not in _ALPHA:
                _ALPHA[c] = chr(c).isalpha()
        out[where] = np.array([_ALPHA[c] for c in distinct.tolist()])[back]
    return out


def grams_of(text: str | None) -> np.ndarray:
    """Hashes of the distinct n-grams of a text, ascending."""
    codes = letters(text or "").astype(np.uint64)
    h, found = np.zeros(len(codes), np.uint64), []
    for size in range(1, min(GRAMS, len(codes)) + 1):
        h = h[: len(codes) - size + 1] * _FACTOR + codes[size - 1 :]
        found.append((h ^ (h >> np.uint64(29))) * _SPREAD)
    if not found:
        return np.zeros(0, np.uint64)
    whole = np.sort(np.concatenate(found))
    new = np.ones(len(whole), bool)
    np.not_equal(whole[1:], whole[:-1], out=new[1:])
    return whole[new]


class Kernel:
    """Nystroem features for a set of landmark texts."""

    def __init__(self, texts: list[str]):
        sets = [grams_of(t) for t in texts]
        self.vocabulary = np.unique(np.concatenate(sets))
        rows = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for row, grams in zip(rows, sets, strict=True):
            row[np.searchsorted(self.vocabulary, grams)] = 1 / np.sqrt(len(grams))
        values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        #: A line for each n-gram: what its presence adds to the features.
        self.map = np.ascontiguousarray((root.T @ rows).T)
        # where each hash can stand, by its first bits
        self.bits = np.uint64(64 - max(1, len(self.vocabulary).bit_length()))
        heads = (self.vocabulary >> self.bits).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << int(64 - self.bits)) + 1))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Indexes of those n-grams that the landmarks have."""
        heads = (grams >> self.bits).astype(np.int64)
        at, end = self.first[heads], self.first[heads + 1]
        found = []
        while len(grams):
            there = at < end
            at, end, grams = at[there], end[there], grams[there]
            found.append(at[self.vocabulary[at] == grams])
            at = at + 1
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features, and which texts have letters."""
        sets = [grams_of(t) for t in texts]
        size = np.array([len(s) for s in sets])
        found = [self.find(s) for s in sets]
        used, column = np.unique(np.concatenate(found), return_inverse=True)
        presence = np.zeros((len(texts), len(used)), np.float32)
        presence[np.repeat(np.arange(len(texts)), [len(x) for x in found]), column] = 1
        return (presence @ self.map[used]) / np.sqrt(np.maximum(size, 1))[:, None].astype(np.float32), size > 0


def landmarks(train: DataFrame, text: str = "text", lang: str = "lang", count: int = LANDMARKS, chars: int = LANDMARK_CHARS) -> tuple[list[str], list[str]]:
    """Landmark texts, ``count`` at most, and the sorted languages: count / languages distinct texts of each (of the
    ``count`` most frequent ones, where there are more), by a hash of the text; of each a piece of ``chars`` characters at most."""
    h = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    rows = train.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"), h.alias("chosen"))
    found = rows.groupBy("lang").agg(F.count("*").alias("all"), F.approx_count_distinct("chosen", COUNT_ERROR).alias("n")).orderBy(F.desc("all"), "lang").limit(LANGS).collect()
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return [], []
    each, shown = max(1, count // len(langs)), found[:count]
    limit = F.element_at(F.create_map(*[F.lit(x) for r in shown for x in (r["lang"], hash_limit(each, r["n"]))]), F.col("lang"))
    place = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    picked = rows.where(F.col("chosen") < limit).select("lang", "chosen", F.col("text").substr(place.cast("int"), F.lit(chars)).alias("text")).distinct()
    ranked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("chosen", "text"))).where(F.col("rank") <= each)
    return [r["text"] for r in ranked.orderBy("lang", "rank").collect()], langs


def fit(train: DataFrame, text: str = "text", lang: str = "lang", count: int = LANDMARKS, ridge: float = RIDGE):
    """(landmark texts, languages, weights) or None without training texts."""
    texts, langs = landmarks(train, text, lang, count)
    if not texts or not any(len(grams_of(t)) for t in texts):
        return None
    code = {x: i for i, x in enumerate(langs)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(texts)
        m = kernel.map.shape[1] + 1
        outer, target, n = np.zeros((m, m)), np.zeros((m, len(langs))), 0
        for batch in blocks(batches, "text"):
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                x, has = kernel.features(part.column("text").to_pylist())
                y = np.full((part.num_rows, len(langs)), -1.0)
                own = np.array([code.get(v, -1) for v in part.column("lang").to_pylist()])
                y[np.flatnonzero(own >= 0), own[own >= 0]] = 1
                has &= own >= 0
                x = np.append(x, np.ones((len(x), 1)), 1)[has]
                outer += x.T @ x
                target += x.T @ y[has]
                n += len(x)
        if n:
            slices = np.array_split(np.append(np.append(outer, target, 1).ravel(), n), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int64()), pa.array([x.tobytes() for x in slices], pa.binary())], ["key", "part", "sums"])

    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = materialise(rows.transform(by_batches, gather, "key long, part long, sums binary"), "sums")
    sums = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(tree_sum(parts, "key", {"sums": "f8"}).collect())])  # SLICES rows
    discard(parts)
    n, lines = sums[-1], sums[:-1]
    m = Kernel(texts).map.shape[1] + 1
    lines = lines.reshape(m, m + len(langs))
    penalty = ridge * n * np.eye(m) / m
    return texts, langs, np.linalg.solve(lines[:, :m] + penalty, lines[:, m:])


def predict(docs: DataFrame, model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, lang_pred and score (0 to 1)."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, weights = model
        kernel = Kernel(texts)
        w, b = weights[:-1].astype(np.float32), weights[-1]
        names = np.array(langs, object)
        for batch in blocks(batches, "text"):
            best, score = [], []
            for i in range(0, batch.num_rows, BATCH):
                x, has = kernel.features(batch.column("text").slice(i, BATCH).to_pylist())
                out = x @ w + b
                top = out.argmax(1)
                share = np.exp(3 * (out - out.max(1, keepdims=True)))
                best.append(np.where(has, names[top], UNKNOWN))
                score.append(np.where(has, 1 / share.sum(1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.concatenate(best), pa.string()), pa.array(np.concatenate(score).astype(np.float64))], ["doc", "lang_pred", "score"])

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    if model is None:
        return rows.select(F.col("doc").alias(doc), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.transform(by_batches, run, f"doc {kind}, lang_pred string, score double").withColumnRenamed("doc", doc)
