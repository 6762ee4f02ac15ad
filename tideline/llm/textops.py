"""Vectorised text features over Arrow string columns.

A block of texts is one byte array with document offsets.  Words are runs of bytes
other than the six ASCII blanks; hashes of words, lines and word windows are
polynomial sums over 64-bit integers, so no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit integer over all bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values(fold_case: bool, blanks: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
    if fold_case:
        v[65:91] = v[97:123]
    if not blanks:
        v[_BLANK] = 0
    return v


_WORD = _byte_values(False, False)
_WORD_FOLDED = _byte_values(True, False)
_LINE = _byte_values(False, True)
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


class Block:
    """Texts of some rows: their bytes, where each begins, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        solid = ~_BLANK[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        inner = offsets[:-1]
        before[inner[inner < len(data)]] = False
        self.solid = solid
        self.starts = np.flatnonzero(solid & ~before)
        #: index of the first word of each text, and one more
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_offsets)
        self.doc_of_word = np.repeat(np.arange(self.n), self.n_words)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes that ``flags`` marks lie in each text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_hashes(self, fold_case: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = _power(len(self.data))
        values = (_WORD_FOLDED if fold_case else _WORD)[self.data]
        values *= up
        return mix(np.add.reduceat(values, self.starts) * down[self.starts])

    def line_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, has a word) of every line, split at newlines."""
        if not len(self.data):
            empty = np.zeros(0, dtype=np.int64)
            return empty.astype(np.uint64), empty, empty.astype(bool)
        up, down = _power(len(self.data))
        newline = self.data == 10
        begins = np.zeros(len(self.data), dtype=bool)
        begins[1:] = newline[:-1]
        inner = self.offsets[:-1]
        begins[inner[inner < len(self.data)]] = True
        at = np.flatnonzero(begins)
        values = _LINE[self.data]
        values[newline] = 0
        values *= up
        h = mix(np.add.reduceat(values, at) * down[at])
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        wordy = np.add.reduceat(self.solid.astype(np.int64), at) > 0
        return h, doc, wordy

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every run of ``width`` words inside a text."""
        if len(hashes) < width:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        last = len(hashes) - width + 1
        h = hashes[:last].copy()
        for i in range(1, width):
            h *= U(0xC2B2AE3D27D4EB4F)
            h ^= h >> U(29)
            h += hashes[i : last + i]
        at = np.flatnonzero(self.doc_of_word[:last] == self.doc_of_word[width - 1 :])
        return mix(h[at]), at


#: ASCII bytes that are no letters, as blanks
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not chr(b).isalpha() and b != 10]] = 32


def blocks(column: pa.Array | pa.ChunkedArray, most_bytes: int = 500_000, letters_only: bool = False) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts of about ``most_bytes``; null counts as empty.

    With ``letters_only`` other ASCII characters than letters separate words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        part = data[offsets[at] : offsets[to]]
        yield Block(_LETTERS[part] if letters_only else part, offsets[at : to + 1] - offsets[at], at)
        at = to
