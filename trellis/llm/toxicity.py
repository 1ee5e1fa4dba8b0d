"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (3 to 5 code points of the lower-cased text,
white space as one blank) that occur in a text, hashed to FEATURES buckets. Each
bucket has a log-count ratio r = log(share among toxic / share among others),
counted over all labelled training texts as distributed sums. A linear model
over r * presence, with logistic loss, is fitted on a bounded sample of the
labelled texts (``sample`` distinct texts at most, half of them of each label,
chosen by a hash of the text; copies of a text count once there).

A text is scored piece by piece: a toxic phrase in a very long text would drown
among thousands of neutral features, so the text is cut into pieces of PIECE
characters (with an overlap of OVERLAP), and its score is that of the worst
piece. Fitting does the same: of a toxic text, the piece with the largest sum
of ratios stands for it; of other texts, likewise the piece that looks worst.

Defined cases: null and empty texts have no features and get the score of the
intercept. An empty table gives no rows. Texts of any length are scored whole. Labels that are null, or of
unknown ids, are not used; of an id that is labelled twice, the larger label
counts. Rows that repeat a doc_id are separate texts with the label of the id.
A text with both labels counts for both. A score of exactly 0.5 is toxic. With
texts of one class only, scores are that class's share. Other columns are not
needed and do not disturb.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import COUNT_ERROR, blocks, by_batches, discard, hash_limit, materialise, tree_sum

FEATURES = 1 << 18
GRAMS = (3, 4, 5)
PIECE = 1500
OVERLAP = 60
#: Labelled texts on which the linear model is fitted, at most.
SAMPLE = 8000
SMOOTH = 1.0
#: Parts in which the sample comes to the driver.
FETCHES = 32
#: Weight of the penalty, and steps of fitting.
PENALTY = 1e-4
STEPS = 300

_MULTIPLIER, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks, runs of white space as one blank."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_buckets(codes: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Bucket of the n-gram of each size at each place: row per size, padded with the bucket count."""
    n = len(codes)
    out = np.full((len(GRAMS), n), features, np.int32)
    h = np.zeros(n, np.uint32)
    shift = np.uint32(32 - (features.bit_length() - 1))
    for size in range(1, GRAMS[-1] + 1):
        if n < size:
            break
        h = h[: n - size + 1] * _MULTIPLIER
        h += codes[size - 1 :]
        if size in GRAMS:
            x = h ^ (h >> np.uint32(15))
            x *= _SPREAD
            x >>= shift
            out[GRAMS.index(size), : n - size + 1] = x
    return out


def pieces_of(n: int) -> list[tuple[int, int]]:
    """Ranges of characters."""
    if n <= PIECE + OVERLAP:
        return [(0, n)]
    return [(i, min(n, i + PIECE + OVERLAP)) for i in range(0, n - OVERLAP, PIECE)]


def distinct(buckets: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each bucket once (the padding not at all). ``place`` is a scratch array of features + 1
    integers: of equal buckets, the one whose position was written last stays."""
    at = np.arange(len(buckets), dtype=np.int32)
    place[buckets] = at
    kept = buckets[place[buckets] == at]
    return kept[kept < len(place) - 1]


def scratch(features: int) -> np.ndarray:
    return np.zeros(features + 1, np.int32)


def pieces_in(buckets: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each piece of a text."""
    for i, j in pieces_of(buckets.shape[1]):
        yield distinct(buckets[:, i:j].ravel(), place)


def labelled(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """text, y (0 or 1) and a hash of the labelled texts. Labels grow with the documents, so they are never broadcast."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(doc).agg(F.max(F.col(label)).alias("y"))
    whole = F.coalesce(text, F.lit(""))
    # hashed before the join, so that counts of distinct texts do not move the texts
    own = docs.select(doc, whole.alias("text"), _chosen(whole).alias("chosen"))
    return own.join(marks.hint("merge"), doc).select("text", (F.col("y") > 0).cast("int").alias("y"), "chosen")


def _chosen(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(1 << 30))


_PARTS = 64


def gather(train: DataFrame, limit: dict[int, int], features: int) -> DataFrame:
    """One pass over the labelled texts. Rows with slice >= 0: of a task (part), how many texts of
    each label have each bucket of that slice of the buckets. Rows with slice -1: the texts of the
    sample, those under a limit of their hash, each once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place, some, taken = np.zeros((2, features + 1), np.int64), scratch(features), False, set()
        task = TaskContext.get().partitionId()
        names = ["slice", "part", "n0", "n1", "text", "y", "chosen"]
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64())
        row = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        for batch in blocks(batches):
            picked = []
            for text, y, chosen in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "chosen")), strict=True):
                total[y, distinct(gram_buckets(codes_of(text), features).ravel(), place)] += 1
                some = True
                if chosen < limit[y] and (key := (y, chosen, hash(text))) not in taken:
                    taken.add(key)
                    picked.append((text, y, chosen))
            if picked:
                n = len(picked)
                yield row([-1] * n, [task] * n, [None] * n, [None] * n, *map(list, zip(*picked, strict=True)))
        if some:
            slices = total[:, :-1].reshape(2, _PARTS, features // _PARTS)
            none = [None] * _PARTS
            yield row(range(_PARTS), [task] * _PARTS, *([x.tobytes() for x in slices[y]] for y in (0, 1)), none, none, none)

    return materialise(train.transform(by_batches, run, "slice int, part long, n0 binary, n1 binary, text string, y int, chosen long"), "gathered")


def log_count_ratios(gathered: DataFrame, features: int) -> np.ndarray:
    """r of each bucket: the tasks' counts summed slice by slice (64 rows of 64 KB come to the driver)."""
    rows = sorted(tree_sum(gathered.where("slice >= 0"), "slice", {"n0": "i8", "n1": "i8"}).collect())
    q, p = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) + SMOOTH for k in (1, 2))
    return np.log((p / p.sum()) / (q / q.sum()))


def fit(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of presence (r included) and intercept by logistic regression on rows of
    present buckets: accelerated gradient steps, with the classes balanced. Rows are taken
    in chunks, which take their place (``rows`` is empty afterwards), so beside them only a few MB are used."""
    size = np.array([len(x) for x in rows])
    scale = r / np.sqrt(max(size.mean(), 1))
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    norms = np.array([(scale[x] ** 2).sum() for x in rows])
    curve = 0.25 * (weight * (norms + 1)).sum() + PENALTY
    chunks = []
    rows.reverse()
    while rows:
        part = [rows.pop() for _ in range(min(200, len(rows)))]
        at = chunks[-1][2].stop if chunks else 0
        owner = np.repeat(np.arange(len(part), dtype=np.uint8), size[at : at + len(part)])
        chunks.append((np.concatenate(part), owner, slice(at, at + len(part))))
        del part
    w, b = np.zeros(len(r)), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(STEPS):
        scaled, slope, total = ahead_w * scale, np.zeros(len(r)), 0.0
        for flat, owner, at in chunks:
            z = np.bincount(owner, scaled[flat], len(y[at])) + ahead_b
            g = weight[at] * (1 / (1 + np.exp(-z)) - y[at])
            slope += np.bincount(flat, g[owner], len(r))
            total += g.sum()
        new_w = ahead_w - (slope * scale + PENALTY * ahead_w) / curve
        new_b = ahead_b - total / curve
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead_w, ahead_b = new_w + (before - 1) / t * (new_w - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w * scale, float(b)


def train_model(train: DataFrame, features: int = FEATURES, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the intercept."""
    if "chosen" not in train.columns:
        train = train.withColumn("chosen", _chosen(F.col("text")))
    found = train.groupBy("y").agg(F.count("*").alias("n"), F.approx_count_distinct("chosen", COUNT_ERROR).alias("distinct")).collect()  # two rows
    sizes = {0: 0, 1: 0} | {r["y"]: r["n"] for r in found}
    if not sizes[0] or not sizes[1]:
        share = sizes[1] / max(sum(sizes.values()), 1)
        return np.zeros(features), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    gathered = gather(train, {r["y"]: hash_limit(sample // 2, r["distinct"]) for r in found}, features)
    r = log_count_ratios(gathered, features)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = scratch(features)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                found.append(max(pieces_in(gram_buckets(codes_of(text), features), place), key=lambda x: r[x].sum()).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("y")], ["found", "y"])

    texts = gathered.where("slice = -1").select("text", "y", "chosen").distinct()
    by_class = [texts.where(F.col("y") == y).orderBy("chosen", "text").limit(sample // 2).select("text", "y") for y in (0, 1)]
    # in parts, so that neither the driver's JVM nor its Python holds the sample twice
    chosen = by_class[0].unionByName(by_class[1]).repartition(FETCHES, F.xxhash64("text")).transform(by_batches, pick, "found binary, y int")
    rows = sorted((int(x["y"]), bytes(x["found"])) for x in chosen.toLocalIterator())
    discard(gathered)
    y = np.array([k for k, _ in rows])
    rows = [np.frombuffer(x, np.int32) for _, x in rows]
    return fit(rows, y, r)


def score(docs: DataFrame, weights: np.ndarray, intercept: float, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and score (0 to 1) of each text. The model (2 MB) travels with the function."""
    features = len(weights)
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = scratch(features)
        for batch in blocks(batches, "text"):
            z = np.array([max(weights[x].sum() for x in pieces_in(gram_buckets(codes_of(t or ""), features), place)) for t in batch.column("text").to_pylist()], np.float64) + intercept
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc", "score"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).transform(by_batches, run, f"doc {kind}, score double").withColumnRenamed("doc", doc)
