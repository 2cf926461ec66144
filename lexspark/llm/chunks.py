"""Cutting a text into parts that byte-level BPE treats independently, so that each distinct part is encoded once.

Under the public pre-tokenisation pattern a run of letters, of digits, of white space or of other characters ends where the next one
begins, but for a blank, which goes with what follows it, and an apostrophe, which may go with letters.  Places where a match surely
begins are found over the bytes of many texts at once.
"""

from __future__ import annotations

import gc
import unicodedata
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The public pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer parts are encoded, not remembered.
LONGEST_KEPT = 64
#: Bound of the remembered parts of a worker.
MOST_KEPT = 1_000_000


@contextmanager
def collector_paused():
    """No cycle search meanwhile: it would walk through long lists of strings time and again, which are no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Generations:
    """A bounded memory in two generations: when the young one is full it becomes the old one, and what the old one had and was
    not asked for again is forgotten."""

    def __init__(self, most: int):
        self.half = max(1, most // 2)
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def age(self) -> None:
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}


# --- parts of an Arrow batch ------------------------------------------------------------------------------------------------

LETTER, DIGIT, OTHER, QUOTE, BLANK, SPACE, BEYOND, DOUBT = range(8)  # BEYOND: any class but white space; DOUBT: any class
_WIDE_SPACES = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of single bytes, and of the characters of two bytes."""
    one = np.full(256, BEYOND, np.uint8)
    one[:128] = OTHER
    for chars, kind in ((range(48, 58), DIGIT), ([*range(65, 91), *range(97, 123)], LETTER), ([39], QUOTE), ([32], BLANK), (range(9, 14), SPACE), (range(28, 32), DOUBT)):
        one[list(chars)] = kind
    two = np.array([LETTER if unicodedata.category(chr(c))[0] == "L" else DOUBT if chr(c).isspace() else BEYOND for c in range(0x800)], np.uint8)
    return one, two


_ONE, _TWO = _classes()
#: Whether a match surely begins between bytes of two classes; 2: if the white space before it is a single character.
_BETWEEN = np.zeros(64, np.uint8)
for _a, _b, _value in (
    (LETTER, (DIGIT, OTHER, QUOTE, BLANK, SPACE), 1),
    (DIGIT, (LETTER, OTHER, QUOTE, BLANK, SPACE), 1),
    (OTHER, (LETTER, DIGIT, BLANK, SPACE), 1),
    (QUOTE, (DIGIT, BLANK, SPACE), 1),
    (BEYOND, (BLANK, SPACE), 1),
    (SPACE, (LETTER, DIGIT, OTHER, QUOTE), 2),
):
    _BETWEEN[[_a * 8 + _x for _x in _b]] = _value


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending places in the UTF-8 bytes ``data`` where a match of the public pattern surely begins, starts of texts among them.

    Text t is ``data[offsets[t]:offsets[t + 1]]``; offsets start at 0 and end with the data.  What lies between two places is split
    by itself as within its text: no look-ahead of the pattern reaches over a place.
    """
    kinds = _ONE[data]
    if len(data) and int(data.max()) >= 0x80:
        at = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        kinds[at] = kinds[at + 1] = _TWO[(data[at].astype(np.int32) & 31) << 6 | data[at + 1] & 63]
        at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
        point = (data[at].astype(np.int32) & 15) << 12 | (data[at + 1].astype(np.int32) & 63) << 6 | data[at + 2] & 63
        at = at[np.isin(point, _WIDE_SPACES)]
        for j in range(3):
            kinds[at + j] = DOUBT
    begins = np.zeros(len(data) + 1, np.uint8)
    begins[1:-1] = _BETWEEN[kinds[:-1] << 3 | kinds[1:]]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = 1
    after = np.flatnonzero(begins == 2)
    long = kinds[after - 2]  # of a text's first character, that of another text or of the data's end; starts of texts tell
    begins[after[((long == BLANK) | (long == SPACE) | (long == DOUBT)) & (begins[after - 1] == 0)]] = 0
    return np.flatnonzero(begins[:-1])


def text_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For other patterns: a text that is not empty is one part."""
    return offsets[:-1][offsets[:-1] < offsets[1:]]


class PartTable:
    """Encodes all texts of an Arrow array at once: their distinct parts are looked up, the ids of all parts are gathered.

    ``encode_parts`` gives the ids of each of a list of parts (UTF-8) as 32-bit numbers; parts that were met are remembered.
    """

    #: Bytes of text whose parts are told apart together, about; temporary arrays take some 30 times as much.
    PORTION = 1 << 22

    def __init__(
        self,
        encode_parts: Callable[[list[bytes]], list[bytes]],
        most: int = MOST_KEPT,
        cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = part_starts,
        portion: int = PORTION,
    ):
        self.encode_parts, self.known, self.cut, self.portion = encode_parts, Generations(most), cut, portion

    def _look(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts."""
        known = self.known
        known.age()
        young, old = known.young, known.old
        got = list(map(young.get, parts))
        absent = [i for i, g in enumerate(got) if g is None]
        missing = []
        for i in absent:
            found = old.get(parts[i])
            if found is None:
                missing.append(i)
            else:
                got[i] = young[parts[i]] = found
        for i, ids in zip(missing, self.encode_parts([parts[i] for i in missing])):
            got[i] = ids
            if len(parts[i]) <= LONGEST_KEPT:
                young[parts[i]] = ids
        return got

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.cut(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int32)
        named = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        index = named.indices.to_numpy()
        with collector_paused():
            got = self._look(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        heads, counts = (np.cumsum(sizes) - sizes)[index], sizes[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(heads - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, offsets[1:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) end to end, and where each text's ids end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        _, where, held = texts.buffers()
        offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        ids, ends, a, before = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0, 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.portion, "right")) - 1)
            own, own_ends = self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(own)
            ends.append(own_ends + before)
            a, before = b, before + len(own)
        return np.concatenate(ids), np.concatenate(ends)
