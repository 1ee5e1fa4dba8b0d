"""Words of many texts at once, as positions in one byte buffer and 64-bit hashes.

Everything is vectorised with numpy over a block of texts. A hash of a span is
a difference of prefix sums of table[byte] * P**i (mod 2**64), moved to the
origin by P**-i and mixed; two lanes with other tables and multipliers give 128
bits, with which equal hashes are taken as equal words.
"""

from __future__ import annotations

import numpy as np

from trellis.llm.shared import keeps

#: ASCII white space: \x20 and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but 0-9, a-z and bytes of non-ASCII characters (texts are lower-cased first).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_LANES = []
for _seed in (1, 2):
    _rng = np.random.Generator(np.random.PCG64(_seed))
    _LANES.append((_rng.integers(0, 2**64, 256, np.uint64), int(_rng.integers(0, 2**63)) * 2 + 1, int(_rng.integers(0, 2**63)) * 2 + 1))
_POWERS: dict[int, np.ndarray] = {}
keeps("powers", _POWERS.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; kept between calls up to 2M entries (16 MB)."""
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        size = max(n + (n >> 3), 1 << 16)
        found = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubles each time
            more = min(done, size - done)
            found[done : done + more] = found[:more] * np.uint64(pow(base, done, 2**64))
            done += more
        if size <= 2 << 20:
            _POWERS[base] = found
    return found[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def word_spans(data: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    word = ~delimiters[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    table, base, _ = _LANES[lane]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(base, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(inverse(base), len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes; len(words) - n + 1 values (runs may cross texts)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = _LANES[lane][2]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(inverse(base), count) + np.uint64(n))


def gram_starts(first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices at which a run of n words starts that stays in its text, and the text of each."""
    counts = np.maximum(np.diff(first_word) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(text)) - before[text] + first_word[:-1][text], text


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)
