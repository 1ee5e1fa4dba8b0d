"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding: the text is normalised (a space becomes U+2581 and one is put in
front), split into symbols, and an agenda of adjacent symbol pairs, ordered by
the score of the merged piece and then from left to right, is emptied. Symbols
that are no pieces become their UTF-8 byte pieces.

No piece of a supported vocabulary has U+2581 after another character (this is
checked when a model is loaded), so no merge crosses the start of a word. Words
can therefore be encoded by themselves and kept in a bounded table of each Python
worker (bounded in bytes, so that texts without spaces, each of which is one
word, take no more memory than others). The new words of a batch are encoded together:
each has its own agenda, a row of a matrix, and all rows give up one pair at a time.
Every word that is encoded is checked
against the sentencepiece library, batch by batch; should one ever differ, the library's ids are taken
and the texts with it are counted in ``n_differ``.

The model's bytes travel with the function (half a megabyte), so executors
need no file of their own.

Defined cases: null is the empty text, which has the begin and end ids only and
decodes to the empty text. Texts of any length are encoded whole. Repeated rows
get one row each; other columns pass through if asked for, unless they have the
name of a result. An empty table gives no rows. Of pairs with equal scores the leftmost is merged first.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import blocks, by_batches, keeps

MARK = "▁"
#: Bytes (about) of one generation of a Python worker's table; two are kept, and one of fragments.
KEEP_BYTES = 32 << 20
#: Words and fragments of more characters are encoded where they stand and not kept.
KEEP_CHARS = 200
#: Symbols up to which a plain list is the faster agenda, and words are encoded many at a time.
SHORT = 64
#: Words whose agendas are one matrix.
ROWS = 4096
#: Words that are compared with the library's ids in one text.
TOGETHER = 64


class MergeModel:
    """The vocabulary of a merge-type model, with encode and decode by pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_ids = {int(pieces[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in self.special and not sp.is_byte(i)}
        self.costs = {p: -sp.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or len(self.byte_ids) != 256 or any(map(sp.is_unused, range(n))):
            raise ValueError("only merge-type vocabularies with byte pieces and without pieces across words are supported")
        #: Two neighbouring symbols that are in no piece are never merged across.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.surface = [b"" if i in self.special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for value, i in self.byte_ids.items():
            self.surface[i] = bytes([value])

    def merge(self, symbols: str) -> list[int]:
        """Ids of a run of symbols: pairs leave the agenda by score, then from the left."""
        parts = self.merged(symbols) if len(symbols) <= SHORT else self.merged_long(symbols)
        ids = []
        for part in parts:
            found = self.ids.get(part)
            ids.extend([found] if found is not None else [self.byte_ids[b] for b in part.encode()])
        return ids

    def merged(self, symbols: str) -> list[str]:
        """The agenda as a list of costs (negative scores) by position; the first of the least is next."""
        cost, never = self.costs.get, float("inf")
        parts = list(symbols)
        agenda = [cost(a + b, never) for a, b in zip(parts, parts[1:])]
        while agenda and (least := min(agenda)) != never:
            i = agenda.index(least)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(parts[i] + parts[i + 1], never)
            if i:
                agenda[i - 1] = cost(parts[i - 1] + parts[i], never)
        return parts

    def merged_long(self, symbols: str) -> list[str]:
        """The agenda as a heap."""
        cost = self.costs.get
        parts: list[str | None] = list(symbols)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            found = cost(parts[i] + parts[i + 1])
            if found is not None:
                agenda.append((found, i, i + 1, parts[i] + parts[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != piece:
                continue  # one of the two has been merged since
            parts[left], parts[right] = piece, None
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                found = cost(piece + parts[beyond])
                if found is not None:
                    heapq.heappush(agenda, (found, left, beyond, piece + parts[beyond]))
            ahead = before[left]
            if ahead >= 0:
                found = cost(parts[ahead] + piece)
                if found is not None:
                    heapq.heappush(agenda, (found, ahead, left, parts[ahead] + piece))
        return [p for p in parts if p is not None]

    @cached_property
    def pairs(self) -> PairTable:
        return PairTable(self)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of up to SHORT symbols (of much the same length, best), as merge() has them."""
        text = "".join(words)
        points, data = np.frombuffer(text.encode("utf-32-le"), "<u4"), np.frombuffer(text.encode(), np.uint8)
        symbols, origin, row = self.pairs.merged(points, np.fromiter(map(len, words), np.int64, len(words)))
        ids = self.pairs.ids[symbols]
        # A symbol has its own id, or one for each byte of the character.
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        first_byte = (np.cumsum(widths) - widths)[origin]
        counts = np.where(ids < 0, widths[origin], 1)
        ends = np.cumsum(counts)
        flat = np.repeat(ids, counts)
        for i in range(4):
            some = np.flatnonzero((ids < 0) & (counts > i))
            flat[ends[some] - counts[some] + i] = self.pairs.byte_ids[data[first_byte[some] + i]]
        packed = flat.astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(row, counts, len(words)).astype(np.int64))).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def fragments(self, word: str) -> list[str]:
        """The word, cut where no piece reaches across."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: control ids vanish, the space in front goes, byte pieces are put together."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class PairTable:
    """Pairs of symbols (numbers of pieces and characters) that make a piece, and agendas of many words."""

    def __init__(self, model: MergeModel):
        number = {p: i for i, p in enumerate(model.ids)}
        for c in sorted({c for p in model.ids for c in p}):
            number.setdefault(c, len(number))
        self.none = len(number)  # stands for what is in no piece, and beyond both ends of a word
        self.ids = np.array([model.ids.get(p, -1) for p in number] + [-1], np.int32)
        self.byte_ids = np.array([model.byte_ids[b] for b in range(256)], np.int32)
        self.characters = np.full(0x110000, self.none, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.characters[ord(c)] = i
        found = sorted((number[p[:i]] * (self.none + 1) + number[p[i:]], cost, number[p]) for p, cost in model.costs.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        keys, costs, pieces = zip(*found, strict=True) if found else ((), (), ())
        # The last entry stands for every pair that makes no piece.
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.pieces = np.array([*pieces, self.none], np.int32)
        self.ranks = np.unique([*costs, np.inf], return_inverse=True)[1].astype(np.int32)
        self.never = self.ranks[-1]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Entries of the pairs."""
        wanted = left * np.int64(self.none + 1) + right
        found = np.searchsorted(self.keys, wanted)
        found[self.keys[found] != wanted] = len(self.keys) - 1
        return found

    def merged(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agendas of words (code points one after another) as rows of costs by position: of each row the first
        of the least is next. Symbols that are left, where in points each begins, and their words."""
        n, width = len(lengths), int(lengths.max(initial=0)) + 2
        columns = np.arange(width)
        alive = (columns > 0) & (columns <= lengths[:, None])  # a place is kept before and after each word
        place = (np.cumsum(lengths) - lengths)[:, None] + columns - 1
        symbols = np.full((n, width), self.none, np.int32)
        symbols[alive] = self.characters[points]
        entry = np.full((n, width), len(self.keys) - 1, np.int64)
        entry[:, 1:-1] = self.find(symbols[:, 1:-1], symbols[:, 2:])
        costs = self.ranks[entry]
        before, after = np.arange(-1, n * width - 1), np.arange(1, n * width + 1)
        symbol, pair, cost, living = symbols.ravel(), entry.ravel(), costs.ravel(), alive.ravel()
        rows = np.arange(n)
        while len(rows):
            at = costs[rows].argmin(axis=1) + rows * width
            some = cost[at] < self.never
            rows, at = rows[some], at[some]
            right, ahead = after[at], before[at]
            beyond = after[right]
            symbol[at], living[right], cost[right] = self.pieces[pair[at]], False, self.never
            after[at], before[beyond] = beyond, at
            for a, b in ((at, beyond), (ahead, at)):
                pair[a] = self.find(symbol[a], symbol[b])
                cost[a] = self.ranks[pair[a]]
        return symbols[alive], place[alive], np.nonzero(alive)[0]


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTable(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers.

    A full table becomes the old generation; words that are met again move on
    to the new one, so frequent words stay and memory is bounded: by KEEP_BYTES
    for each generation, and a block of texts."""

    def __init__(self, model: MergeModel):
        super().__init__()
        self.model, self.fresh, self.differ, self.long = model, [], set(), []
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.size = self.parts_size = 0

    def meet(self, words: Iterator[str]) -> None:
        """Take in the words that are not in the table."""
        short = []
        for word in dict.fromkeys(words):
            if word in self:
                continue
            found = self.old.get(word)
            if found is not None:
                self.take(word, found)
            elif len(word) <= SHORT:
                short.append(word)
            else:
                self.take(word, b"".join([self.parts.get(p) or self.part(p) for p in self.model.fragments(word)]))
                self.fresh.append(word)
        short.sort(key=len)
        for i in range(0, len(short), ROWS):
            some = short[i : i + ROWS]
            for word, found in zip(some, self.model.merge_words(some), strict=True):
                self.take(word, found)
        self.fresh += short

    def take(self, word: str, found: bytes) -> None:
        self[word] = found
        if len(word) > KEEP_CHARS:
            self.long.append(word)
        else:
            self.size += 150 + 2 * len(word) + len(found)  # with what the objects take

    def part(self, fragment: str) -> bytes:
        found = packed_ids(self.model.merge(fragment))
        if len(fragment) <= KEEP_CHARS:
            self.parts[fragment] = found
            self.parts_size += 150 + 2 * len(fragment) + len(found)
        return found

    def settle(self) -> None:
        """Check what has come in against the library, some words at a time in one text (no merge
        crosses the start of a word), and one by one where that differs; then its ids are taken."""
        fresh, self.fresh = self.fresh, []
        encode = self.model.library.encode
        single = [w for w in fresh if w[-1] == MARK]  # the next word's marks would join them
        fresh = [w for w in fresh if w[-1] != MARK]
        groups = [fresh[i : i + TOGETHER] for i in range(0, len(fresh), TOGETHER)]
        for group, ids in zip(groups, encode(["".join(g)[1:].replace(MARK, " ") for g in groups], num_threads=1) if groups else [], strict=True):
            if packed_ids(ids) != b"".join([self[w] for w in group]):
                single += group
        for word, ids in zip(single, encode([w[1:].replace(MARK, " ") for w in single], num_threads=1) if single else [], strict=True):
            if word == MARK:  # the library gives nothing for the empty text
                continue
            ids = packed_ids(ids)
            if ids != self[word]:
                self[word] = ids
                self.differ.add(word)

    def trim(self) -> None:
        for word in self.long:
            self.pop(word, None)
        self.long.clear()
        if self.size > KEEP_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = 0
        if self.parts_size > KEEP_BYTES:
            self.parts.clear()
            self.parts_size = 0


_TABLES: dict[str, WordTable] = {}
keeps("spm", _TABLES.clear)


def table_for(model: bytes) -> WordTable:
    """This worker's table for the model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _TABLES:
        _TABLES[key] = WordTable(MergeModel(model))
    return _TABLES[key]


def split_words(text: str) -> list[str]:
    """Runs of U+2581 with the characters that follow; joined they are the normalised text."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return [MARK + p for p in parts]
    words, marks = [], ""
    for part in parts:
        marks += MARK
        if part:
            words.append(marks + part)
            marks = ""
    if marks:
        words.append(marks)
    return words


def encode_block(texts: list[str], table: WordTable) -> tuple[list[bytes], list[int]]:
    """Packed ids of each text without begin and end, and how many of its words differed from the library's."""
    split = [split_words(t or "") for t in texts]
    table.meet(chain.from_iterable(split))
    table.settle()
    out = [b"".join([table[w] for w in words]) for words in split]
    differ = [sum(w in table.differ for w in words) for words in split] if table.differ else [0] * len(texts)
    table.trim()
    return out, differ


def _pass_through(df: DataFrame, keep: list[str]):
    return [f for f in df.schema.fields if f.name in keep]


def encode(df: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (array<int> with begin and end), ``n_tokens``, ``n_differ``."""
    from pyspark.sql import types as T

    names = [c for c in keep if c not in ("ids", "n_tokens", "n_differ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(model)
        begin, end = (np.array([x], "<i4").tobytes() for x in (table.model.begin, table.model.end))
        for batch in blocks(batches, "__text", 1 << 20):
            packed, differ = encode_block(batch.column("__text").to_pylist(), table)
            packed = [begin + p + end for p in packed]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(differ, pa.int64())], [*names, "ids", "n_tokens", "n_differ"])

    fields = [*_pass_through(df, names), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("n_differ", T.LongType())]
    fields = sorted(fields[: len(names)], key=lambda f: names.index(f.name)) + fields[len(names) :]
    return df.select(*names, F.col(text).alias("__text")).transform(by_batches, run, T.StructType(fields), "spm")


def encode_digests(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text in one pass; per row n_tokens and the digests of
    ids and of the decoded text. ``with_ids`` adds the packed ids themselves (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(model)
        begin, end = (np.array([x], "<u4").tobytes() for x in (table.model.begin, table.model.end))
        decode, sha = table.model.decode, hashlib.sha256
        for batch in blocks(batches, "__text", 1 << 20):
            packed, differ = encode_block(batch.column("__text").to_pylist(), table)
            packed = [begin + p + end for p in packed]
            decoded = [sha(decode(np.frombuffer(p, "<u4").tolist()).encode()).hexdigest() for p in packed]
            columns = [batch.column(key), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p).hexdigest() for p in packed], pa.string()), pa.array(decoded, pa.string()), pa.array(differ, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(packed, pa.binary())] * with_ids], [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_differ", *["ids"] * with_ids])

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differ long" + ", ids binary" * with_ids
    return df.select(key, F.col(text).alias("__text")).transform(by_batches, run, schema, "spm")


def decode(df: DataFrame, model: bytes, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text`` decoded from an array<int> column; null ids give the empty text."""
    from pyspark.sql import types as T

    names = [c for c in keep if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = table_for(model).model.decode
        for batch in batches:
            texts = [unpack(x or []) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    fields = sorted(_pass_through(df, names), key=lambda f: names.index(f.name))
    return df.select(*names, F.col(ids).alias("__ids")).transform(by_batches, run, T.StructType([*fields, T.StructField("text", T.StringType())]), "spm")
