"""LM scoring by subword lattices.

Every word of a text, with the word mark in front, is a lattice: all its
segmentations into pieces of an existing vocabulary. Its probability is the sum
over segmentations of the products of piece probabilities, by a forward
recursion in log space; a text's is the product over its words and one end.
Pieces do not reach across words, so this is the marginal over all
segmentations of the text.

The vocabulary and its first scores are those of the model file. The file at
hand is of the merge type: its scores are ranks, not log probabilities. They
are turned into a first distribution (proportional to 1 / (rank + RANK0)) and
re-estimated by rounds of expectation maximisation over the words of all
training texts: expected piece counts by forward and backward recursions,
weighted with the words' counts. Characters outside the vocabulary cost their
UTF-8 bytes, as byte pieces. Piece probabilities and the end sum to one.

The word table (word, count) is one shuffle and as large as the corpus makes
it. Each word of it is scored once. Counts and scores come to the texts in two ways:
the HEAD most frequent words travel to all tasks (a table bounded in rows and bytes), and the rest
is joined: a text's remaining words, counted, are sent to the word table, and
those that it lacks are scored where they arrive. Words are compared as strings.
Words of more than LONG characters (texts without spaces are such words) are cut
where no piece reaches across, which leaves their sum over segmentations as it
is; equal fragments are scored once, and what is still longer than STEPWISE
characters is scored character by character instead of as an array.

Defined cases: null and empty texts consist of the end alone. With no training
texts all counts are 0, and the piece probabilities are the first ones. Rows
that repeat a doc_id are separate texts; a null doc_id is hashed as the empty
text. Texts of any length are scored whole. An empty table of texts has no rows.
Other columns are not needed and do not disturb.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import kernel as K
from trellis.llm.shared import blocks, by_batches, discard, keeps, materialise, text_bytes

#: Words that travel to all tasks, and their bytes, at most.
HEAD, HEAD_BYTES = 1 << 17, 16 << 20
ROUNDS = 4
RANK0 = 20.0
#: Added to each piece's expected count.
SMOOTH = 0.1
MARK = "▁"
#: Characters from which a word is cut into fragments, and a fragment is not an array's line.
LONG, STEPWISE = 64, 512


_SHAPES: dict[str, tuple] = {}
keeps("lattice", _SHAPES.clear)


class Pieces:
    """Piece strings of a vocabulary and log probabilities; the last 256 entries are bytes."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        key = hashlib.sha256("\n".join(pieces).encode()).hexdigest()
        if key not in _SHAPES:
            _SHAPES.clear()
            _SHAPES[key] = self._shape()
        self.longest, self.order, self.hashes, self.first, self.depth, self.inside, self.index = _SHAPES[key]

    def _shape(self) -> tuple:
        """All that does not depend on probabilities; a worker keeps it between tasks."""
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.int64) for p in self.pieces]
        hashes = K.mix(np.array([self._hash(c) for c in codes], np.uint64))
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.searchsorted(hashes, np.arange((1 << 21) + 1, dtype=np.uint64) << np.uint64(64 - 21)).astype(np.int32)
        # neighbours that some piece has inside; between others a word can be cut
        flat, size = np.concatenate(codes), np.array([len(c) for c in codes])
        ends = np.cumsum(size)
        within = np.ones(len(flat), bool)
        within[ends - 1] = False
        within = np.flatnonzero(within)
        inside = np.unique((flat[within] << 32) + flat[within + 1])
        return int(size.max()), order, hashes, first, int(np.diff(first).max()), inside, {p: i for i, p in enumerate(self.pieces)}

    BASE = 0x9E3779B97F4A7C15 | 1

    def _hash(self, codes: np.ndarray) -> int:
        h = 0
        for c in codes:
            h = (h * self.BASE + int(c) + 1) % 2**64
        return h

    def find(self, raw: np.ndarray) -> np.ndarray:
        """Index of the piece with each polynomial hash, or -1."""
        h = K.mix(raw)
        at = self.first[(h >> np.uint64(64 - 21)).astype(np.int64)]
        out = np.full(len(h), -1)
        for _ in range(self.depth):
            at_ = np.minimum(at, len(self.hashes) - 1)
            hit = self.hashes[at_] == h
            out[hit] = self.order[at_[hit]]
            at = at + 1
        return out


def byte_cost(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def _lattice(words: list[str], pieces: Pieces, log_byte: float):
    """For strings of one length n: edges[length - 1][start] = (piece or -1 for bytes, log p), as arrays."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
    raw = np.zeros_like(codes)
    found, logs = [], []
    for length in range(1, min(n, pieces.longest) + 1):
        raw = raw[:, : n - length + 1] * np.uint64(Pieces.BASE) + codes[:, length - 1 :] + np.uint64(1)
        index = pieces.find(raw.ravel()).reshape(raw.shape)
        log = np.where(index >= 0, pieces.logp[index], -np.inf)
        if length == 1:
            log = np.where(index >= 0, log, byte_cost(codes) * log_byte)
        found.append(index)
        logs.append(log)
    return n, codes, found, logs


def _fragments(words: list[str], pieces: Pieces) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The parts of the marked words that are scored; for each use of a part, the word and the part."""
    parts = [MARK + w for w in words]
    word = part = np.arange(len(parts))
    long = [i for i, w in enumerate(parts) if len(w) > LONG]
    if not long:
        return parts, word, part
    at: dict[str, int] = {}
    more_word, more_part = [], []
    for i in long:
        w = parts[i]
        codes = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64)
        cuts = (np.flatnonzero(~np.isin((codes[:-1] << 32) + codes[1:], pieces.inside)) + 1).tolist()
        own = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)]
        more_word += [i] * len(own)
        more_part += [at.setdefault(x, len(at)) for x in own]
    keep = np.ones(len(parts), bool)
    keep[long] = False
    short = np.flatnonzero(keep)
    # the short words first, then the distinct fragments of the long ones
    return [parts[i] for i in short] + list(at), np.append(short, more_word), np.append(np.arange(len(short)), np.array(more_part) + len(short))


def _stepwise(text: str, pieces: Pieces, log_byte: float, backwards: bool = False) -> list[float]:
    """Log probability of each prefix (or suffix, by its start) of one string."""
    index, logp, longest, n = pieces.index, pieces.logp, pieces.longest, len(text)
    out = [0.0]  # of the prefix (suffix) of 0, 1, ... characters
    for end in range(1, n + 1):
        terms = []
        for k in range(1, min(end, longest) + 1):
            edge = text[n - end : n - end + k] if backwards else text[end - k : end]
            found = index.get(edge)
            if found is not None:
                terms.append(out[end - k] + logp[found])
            elif k == 1:
                terms.append(out[end - 1] + len(edge.encode("utf-8", "surrogatepass")) * log_byte)
        top = max(terms)
        out.append(top + math.log(sum([math.exp(t - top) for t in terms])))
    return out[::-1] if backwards else out


def _logsum(rows: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(rows)
    top = stack.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    return safe + np.log(np.exp(stack - safe).sum(0))


def forward(n: int, logs: list[np.ndarray]) -> np.ndarray:
    """Log probability of each prefix (columns 0 to n)."""
    alpha = np.full((n + 1, logs[0].shape[0]), -np.inf)
    alpha[0] = 0.0
    for end in range(1, n + 1):
        alpha[end] = _logsum([alpha[end - k] + logs[k - 1][:, end - k] for k in range(1, min(end, len(logs)) + 1)])
    return alpha


def backward(n: int, logs: list[np.ndarray]) -> np.ndarray:
    beta = np.full((n + 1, logs[0].shape[0]), -np.inf)
    beta[n] = 0.0
    for start in range(n - 1, -1, -1):
        beta[start] = _logsum([beta[start + k] + logs[k - 1][:, start] for k in range(1, min(n - start, len(logs)) + 1)])
    return beta


def _by_length(words: list[str]):
    """Indices of words of equal length, in slices of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            step = max(1, 40_000 // int(lengths[part[0]]))
            for i in range(0, len(part), step):
                yield part[i : i + step]


def word_scores(words: list[str], pieces: Pieces, log_byte: float) -> np.ndarray:
    """Natural log of each word's probability."""
    parts, word, part = _fragments(words, pieces)
    score = np.zeros(len(parts))
    for some in _by_length(parts):
        if len(parts[some[0]]) > STEPWISE:
            score[some] = [_stepwise(parts[i], pieces, log_byte)[-1] for i in some]
        else:
            n, _, _, logs = _lattice([parts[i] for i in some], pieces, log_byte)
            score[some] = forward(n, logs)[n]
    return np.bincount(word, score[part], len(words))


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, log_byte: float) -> np.ndarray:
    """Expected uses of each piece; the last entry is for bytes."""
    total = np.zeros(len(pieces.pieces) + 1)
    parts, word, part = _fragments(words, pieces)
    times = np.bincount(part, counts[word], len(parts))
    for some in _by_length(parts):
        if len(parts[some[0]]) > STEPWISE:
            for i in some:
                _count_stepwise(parts[i], times[i], pieces, log_byte, total)
            continue
        n, codes, found, logs = _lattice([parts[i] for i in some], pieces, log_byte)
        alpha, beta, c = forward(n, logs), backward(n, logs), times[some]
        for k, (index, log) in enumerate(zip(found, logs, strict=True), 1):
            weight = c[:, None] * np.exp(alpha[: n - k + 1].T + log + beta[k : n + 1].T - alpha[n][:, None])
            if k == 1:
                weight = np.where(index >= 0, weight, weight * byte_cost(codes))
            total += np.bincount(np.where(index >= 0, index, len(total) - 1).ravel(), weight.ravel(), len(total))
    return total


def _count_stepwise(text: str, times: float, pieces: Pieces, log_byte: float, total: np.ndarray) -> None:
    alpha, beta = _stepwise(text, pieces, log_byte), _stepwise(text, pieces, log_byte, True)
    whole = alpha[-1]
    for start in range(len(text)):
        for k in range(1, min(len(text) - start, pieces.longest) + 1):
            found = pieces.index.get(text[start : start + k])
            if found is not None:
                total[found] += times * math.exp(alpha[start] + pieces.logp[found] + beta[start + k] - whole)
            elif k == 1:
                size = len(text[start].encode("utf-8", "surrogatepass"))
                total[-1] += times * size * math.exp(alpha[start] + size * log_byte + beta[start + 1] - whole)


def vocabulary(model: bytes) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece model, and their probabilities before training (the bytes' share comes last)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = np.array([sp.get_score(i) for i in ids])
    rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    weight = 1 / (rank + RANK0)
    return [sp.id_to_piece(i) for i in ids], np.append(0.99 * weight / weight.sum(), 0.01)


def tokens_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows (A-Z lower-cased), and the index of each row's first word."""
    data, offsets = text_bytes(column)
    data = K.LOWER[data]
    starts, ends, first = K.word_spans(data, offsets, K.SPACES)
    size = ends - starts
    # the words' bytes one after another
    word_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    packed = data[~K.SPACES[data]]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(word_at), pa.py_buffer(np.ascontiguousarray(packed))]), first


def _counted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    table = pc.value_counts(words)
    return table.field("values"), table.field("counts").to_numpy()


def word_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, c: occurrences in all texts. Words are counted within blocks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in blocks(batches, "text"):
            gathered.append(_counted(tokens_of(batch.column("text"))[0]))
            size += gathered[-1][0].nbytes
            if size > 48 << 20:
                yield from _flush(gathered)
                size = 0
        yield from _flush(gathered)

    rows = docs.select(F.col(text).alias("text")).transform(by_batches, run, "word string, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def _flush(gathered: list) -> Iterator[pa.RecordBatch]:
    if gathered:
        table = pa.table({"word": pa.concat_arrays([w for w, _ in gathered]), "c": np.concatenate([c for _, c in gathered])})
        gathered.clear()
        table = table.group_by("word").aggregate([("c", "sum")])
        yield from pa.table({"word": table["word"].cast(pa.string()), "c": table["c_sum"]}).to_batches()


def train_pieces(words: DataFrame, model: bytes, ends: int, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Pieces and natural log probabilities (bytes, then the end, come last) after EM
    over the word table. Each round is one Spark job; a task sends one row of counts for
    the pieces it met, and the sums (one row a piece) come to the driver."""
    names, p = vocabulary(model)
    expected_ends = float(max(ends, 1))
    tokens = None
    for _ in range(rounds):
        logp, log_byte = np.log(p[:-1]), math.log(p[-1] / 256)

        def run(batches: Iterator[pa.RecordBatch], logp=logp, log_byte=log_byte) -> Iterator[pa.RecordBatch]:
            pieces, total = Pieces(names, logp), np.zeros(len(names) + 1)
            for batch in batches:
                for i in range(0, batch.num_rows, 50_000):
                    part = batch.slice(i, 50_000)
                    total += expected_counts(part.column("word").to_pylist(), part.column("c").to_numpy().astype(float), pieces, log_byte)
            used = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        rows = words.transform(by_batches, run, "piece long, n double", "lattice").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(len(p), SMOOTH)
        counts[rows["piece"].to_numpy(int)] += rows["n"].to_numpy(float)
        tokens = counts.sum()
        p = counts / tokens
    end = expected_ends / (expected_ends + (tokens if tokens is not None and ends else expected_ends * 100))
    return names, np.log(np.append(p * (1 - end), end))


def frequent_words(words: DataFrame, head: int, most_bytes: int = HEAD_BYTES) -> DataFrame:
    """The most frequent words, ``head`` at most and of ``most_bytes`` at most: all from the least count, in
    steps of 2**(1/8), that does not let in more. Only the histogram (a row a step) is gathered before."""
    step = F.floor(F.log2("c") * 8)
    total, size, least = 0, 0, None
    for row in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).collect(), reverse=True):
        total, size = total + row["n"], size + row["size"]
        if total > head or size > most_bytes:
            break
        least = row["step"]
    return words.where(step >= least) if least is not None else words.limit(0)


def _scored(names: list[str], logp: np.ndarray):
    """A function of Arrow batches that fills the score s of words where it is null; other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_byte = Pieces(names, logp[: len(names)]), logp[-2] - math.log(256)
        for batch in batches:
            for i in range(0, batch.num_rows, 50_000):
                part = batch.slice(i, 50_000)
                s = part.column("s").to_numpy(zero_copy_only=False).astype(float)
                missing = np.isnan(s)
                coded = part.column("word").filter(pa.array(missing)).dictionary_encode()
                s[missing] = word_scores(coded.dictionary.to_pylist(), pieces, log_byte)[coded.indices.to_numpy()]
                yield part.set_column(part.schema.get_field_index("s"), "s", pa.array(s))

    return run


def score(docs: DataFrame, train: DataFrame, model: bytes, doc: str = "doc_id", text: str = "text", head: int = HEAD, rounds: int = ROUNDS, alpha: float = 0.1) -> DataFrame:
    """doc, n_tokens, n_known, train_tokens, base_score and score (both log10) of each
    text of docs, for the model of the texts of train."""
    words = materialise(word_table(train, text), "words")
    totals = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    names, logp = train_pieces(words, model, ends, rounds)
    fill = _scored(names, logp)
    lexicon = materialise(words.withColumn("s", F.lit(None).cast("double")).transform(by_batches, fill, "word string, c long, s double", "lattice"), "lexicon")
    discard(words)
    frequent = frequent_words(lexicon, head).toPandas()  # ``head`` rows and HEAD_BYTES at most
    head_words = pa.array(frequent["word"], pa.large_string())
    head_counts = np.append(frequent["c"].to_numpy(np.int64), 0)
    head_scores = np.append(frequent["s"].to_numpy(float), 0.0)
    log_of = lambda c: np.log10((c + alpha) / (n + alpha * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_base = log_of(head_counts)
        head_base[-1] = 0.0
        row = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, "text", 8 << 20):
            tokens, first = tokens_of(batch.column("text"))
            coded = tokens.dictionary_encode()
            codes, distinct = coded.indices.to_numpy(), coded.dictionary
            at = pc.index_in(distinct, value_set=head_words).fill_null(len(head_words)).to_numpy()
            tail = at == len(head_words)
            sums = [np.concatenate([[0], np.cumsum(x[codes])]) for x in (head_scores[at], head_base[at], ~tail)]
            per = [x[first[1:]] - x[first[:-1]] for x in sums]
            # the words that are not in the head, counted for each text
            where = np.flatnonzero(tail[codes])
            key = (np.searchsorted(first, where, side="right") - 1) * len(distinct) + codes[where]
            pairs, times = np.unique(key, return_counts=True)
            owner = pairs // max(len(distinct), 1)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([distinct.take(pa.array(pairs % max(len(distinct), 1))).cast(pa.string()), pa.array(times.astype(np.int32))], ["word", "times"]))
            columns = [np.arange(row, row + batch.num_rows), np.diff(first) + 1, per[0] + logp[-1], per[1] + log_of(ends), per[2].astype(np.int64) + (ends > 0)]
            columns = [pa.array(x) for x in columns]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column("doc"), *columns[1:], rest], ["row", "doc", "n_tokens", "head_score", "head_base", "head_known", "rest"])
            row += batch.num_rows

    kind = docs.schema[doc].dataType.simpleString()
    schema = f"row long, doc {kind}, n_tokens long, head_score double, head_base double, head_known long, rest array<struct<word:string,times:int>>"
    counted = materialise(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).transform(by_batches, run, schema), "counted")
    rest = counted.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    found = rest.join(lexicon, "word", "left").select("word", "row", "times", "c", "s").transform(by_batches, fill, "word string, row long, times int, c long, s double", "lattice")
    c = F.coalesce("c", F.lit(0))
    tails = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + alpha) / F.lit(n + alpha * (v + 1)))).alias("base"), F.sum(F.col("times") * F.col("s")).alias("tail_score"), F.sum(F.when(c > 0, F.col("times"))).alias("known")
    )
    whole = counted.drop("rest").join(tails, "row", "left")
    or_zero = lambda name, zero=0.0: F.coalesce(F.col(name), F.lit(zero))
    return whole.select(
        F.col("doc").alias(doc), "n_tokens", (F.col("head_known") + or_zero("known", 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + or_zero("base")).alias("base_score"), ((F.col("head_score") + or_zero("tail_score")) / math.log(10)).alias("score"),
    )
