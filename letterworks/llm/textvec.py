"""Whole-batch text work in numpy for use inside Arrow tasks.

A string column is read straight from its Arrow buffers and handled in pieces of
bounded size, so memory does not follow the batch size. Texts are never cut: a
piece holds at least one whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed constants of the hash functions.
BASE = np.uint64(0x9E3779B97F4A7C13)
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
GAP = np.uint64(0x2545F4914F6CDD1D)

PIECE_BYTES = 1 << 20

_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
#: Separators of the loose tokenizer: every ASCII byte that is no letter or digit.
_loose = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x ^= x >> np.uint64(29)
    x *= MIX_2
    x ^= x >> np.uint64(32)
    return x


_byte_code = mix(np.arange(1, 257, dtype=np.uint64) * GAP)
_folded_code = _byte_code.copy()
_folded_code[65:91] = _folded_code[97:123]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, factor in enumerate((BASE, inverse)):
            steps = np.full(n, factor)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def pieces(column: pa.Array | pa.ChunkedArray, max_bytes: int = PIECE_BYTES):
    """Yield ``(first_row, bytes, offsets)`` for runs of whole texts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offs, offs[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), len(column), row + 8192)
        yield row, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """The words of a run of texts: start, end and hash of each, and the bounds of each text in them."""

    __slots__ = ("bounds", "ends", "hashes", "starts")

    def __init__(self, raw: np.ndarray, offs: np.ndarray, *, fold: bool = False, loose: bool = False):
        word = ~(_loose if loose else _space)[raw]
        n = len(raw)
        first = word.copy()
        last = word.copy()
        if n:
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = offs[(offs > 0) & (offs < n)]
            first[inner] = word[inner]
            last[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        power, inverse = _power_tables(n + 1)
        codes = (_folded_code if fold else _byte_code)[raw]
        codes *= power[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def runs_hash(words: Words, size: int, *, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the index of each run's first word.

    A text with fewer words gives one run of all its words if ``whole_short``.
    """
    h, n = words.hashes, len(words.hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = words.counts()
    stop = np.repeat(words.bounds[1:], counts)
    at = np.arange(n)
    left = stop - at
    out = np.zeros(n, np.uint64)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(size):
        out = out * BASE + np.where(left > k, padded[k : k + n], np.uint64(0))
    keep = left >= size
    if whole_short:
        begins = at == np.repeat(words.bounds[:-1], counts)
        keep |= begins & (left < size)
    found = np.flatnonzero(keep)
    return mix(out[found]), found
