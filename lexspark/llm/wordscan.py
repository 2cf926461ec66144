"""Words of many texts at once: bounds, hashes, winnowed grams and windows as arrays over the bytes of an Arrow batch.

A *word* is a run of characters between blanks; of scripts that are written without blanks, each character is one.  Texts lie end
to end in one byte array, as Arrow stores them; no array operation is made per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Thai to Burmese, Khmer, kana, Han and its extensions: first and last code points (fixed values).
UNSPACED_RANGES = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Bytes of text per step; temporary arrays take some 40 times as much.  A longer text is a step of its own.
STEP_BYTES = 1 << 20
_POWERS = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(0xD6E8FEB86659FD93, _POWERS)
_POW_STEP = int(_POW[-1]) * 0xD6E8FEB86659FD93 % (1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


@dataclass
class Words:
    """Words of consecutive texts; ``first[t]`` is the number of words before text t (one more entry than texts)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1

    def whole(self, length: int) -> np.ndarray:
        """Ascending numbers of the words at which a window of ``length`` words of one text begins."""
        sizes = np.diff(self.first)
        last = np.repeat(self.first[1:], sizes)
        return np.flatnonzero(np.arange(len(self.starts)) + length <= last)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the same text before each word's end, and before the end of the word before it."""
        sizes = np.diff(self.first)
        end = self.ends - np.repeat(self.offsets[:-1], sizes)
        earlier = np.concatenate([[0], end[:-1]])[: len(end)]
        earlier[self.first[:-1][sizes > 0]] = 0
        return end, earlier


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and lengths of the characters of scripts without blanks."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return lead, lead
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    b = [padded[lead + i].astype(np.uint32) for i in range(4)]
    three = b[0] < 0xF0
    point = np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)
    hit = np.zeros(len(lead), bool)
    for low, high in UNSPACED_RANGES:
        hit |= (point >= low) & (point <= high)
    return lead[hit], np.where(three[hit], 3, 4)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, made of some 100,000 words at a time."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 100_000):
        s, e = starts[a : a + 100_000], ends[a : a + 100_000]
        lengths = e - s
        # bytes of these words only, end to end
        heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        within = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        values = _BYTE[data[np.repeat(s, lengths) + within]]
        if int(lengths.max()) <= _POWERS:
            values *= _POW[within]
        else:
            high = _powers(_POW_STEP, int(lengths.max()) // _POWERS + 1)
            values *= _POW[within % _POWERS] * high[within // _POWERS]
        out[a : a + 100_000] = mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """``data[offsets[t]:offsets[t + 1]]`` is text t; offsets start at 0 and end with the data."""
    blank = _BLANK[data]
    begin = ~blank
    begin[1:] &= blank[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = ~blank[heads]
    at, size = _unspaced(data)
    if len(at):
        begin[at] = True
        after = at + size
        after = after[after < len(data)]
        begin[after] |= ~blank[after]
    stop = ~blank
    if len(data):
        stop[:-1] &= blank[1:] | begin[1:]
        stop[heads[1:] - 1] = ~blank[heads[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = _hash_words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def steps(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Words of rows [a, b) of a column without nulls, a bounded number of bytes at a time."""
    texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, "right")) - 1)
        yield a, b, words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def runs_hashed(hashes: np.ndarray, length: int, at: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words that begin at the words ``at``: halves are joined by doubling, for all places at once."""
    level, size, out, done = hashes, 1, np.zeros(len(at), np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                out = out * np.uint64(pow(base, size, 1 << 64)) + level[at + done]
                done += size
            if size * 2 > length:
                return mix(out)
            level = level[:-size] * np.uint64(pow(base, size, 1 << 64)) + level[size:]
            size *= 2


def winnowed(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` words (the words at which they begin), and the word that each chooses, ascending.

    Of the words at which a gram of the window begins, the one with the least hash is chosen, the rightmost on ties.
    """
    windows = words.whole(length)
    if not len(windows):
        return windows, windows
    low = np.uint64(0xFFFFFFFF)
    count = len(words.hashes)
    least = (words.hashes & ~low) | (low - np.arange(count, dtype=np.uint64))
    size, wanted = 1, length - gram + 1
    while size < wanted:
        by = min(size, wanted - size)
        least = np.minimum(least[:-by], least[by:])
        size += by
    return windows, (low - (least[windows] & low)).astype(np.int64)
