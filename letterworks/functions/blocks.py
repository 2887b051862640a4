"""Similarity of two texts by matching blocks, without comparing all pairs of places.

The measure is the usual one of longest blocks: take the longest common run of
characters, extend it, go on left and right of it, and relate twice the sum of all blocks
to the length of both texts. In a second text of ``LONG`` characters and more, characters
that make up more than a hundredth of it do not start a block; blocks only grow over them.

Runs of the characters that do start blocks are numbered by doubling, so runs of any
length are compared by a number. For each length the places of the first text whose run
is somewhere in the second are scanned from the left; left of a block the next shorter
length is tried, right of it the same one, so no place is scanned twice for a length but
by shorter pieces. For texts without very many equal runs that is about linear.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: From this length on frequent characters start no block; more than this share (and one) is frequent.
LONG, SHARE = 200, 100


class _Runs:
    """Runs of block-starting characters in two texts, found by length."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        kinds, number, counts = np.unique(b, return_inverse=True, return_counts=True)
        able = counts <= len(b) // SHARE + 1 if len(b) >= LONG else np.ones(len(kinds), bool)
        own = np.where(able[number], number, -1)
        place = np.minimum(np.searchsorted(kinds, a), len(kinds) - 1)
        other = np.where((kinds[place] == a) & able[place], place, -1)
        codes = np.concatenate([other, [-1], own, [-1]])
        stops = np.flatnonzero(codes < 0)
        #: How many characters that start blocks follow from each place on.
        self.left = stops[np.searchsorted(stops, np.arange(len(codes)))] - np.arange(len(codes))
        self.ranks = [codes]
        self.of_length: dict[int, tuple[list[int], list[int], dict[int, list[int]]]] = {}

    def numbers(self, k: int) -> np.ndarray:
        """A number for the run of ``k`` characters at each place; equal runs have the same."""
        p = k.bit_length() - 1
        while len(self.ranks) <= p:
            half = self.ranks[-1]
            step = 1 << (len(self.ranks) - 1)
            pair = half * (len(half) + 1)
            pair[: len(half) - step] += half[step:]
            self.ranks.append(np.unique(pair, return_inverse=True)[1])
        rank, step = self.ranks[p], k - (1 << p)
        if not step:
            return rank
        pair = rank * (len(rank) + 1)
        pair[: len(rank) - step] += rank[step:]
        return pair

    def shared(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the first and in the second text of the runs of ``k`` that both have, and their numbers."""
        n = len(self.a) + 1
        at = np.flatnonzero(self.left >= k)
        x, y = at[at < n], at[at >= n]
        numbers = self.numbers(k)
        nx, ny = numbers[x], numbers[y]
        keep_x, keep_y = np.isin(nx, ny), np.isin(ny, nx)
        return x[keep_x], nx[keep_x], y[keep_y] - n, ny[keep_y]

    def longest(self) -> int:
        """The longest run that both texts have."""
        low, high = 0, int(self.left.max(initial=0))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(self.shared(mid)[0]) else (low, mid - 1)
        return low

    def first(self, k: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
        """The leftmost run of ``k`` of the first text in its range that the second has in its range, and its leftmost place there."""
        if k not in self.of_length:
            x, nx, y, ny = self.shared(k)
            places: dict[int, list[int]] = {}
            for number, j in zip(ny.tolist(), y.tolist(), strict=True):
                places.setdefault(number, []).append(j)
            self.of_length[k] = x.tolist(), nx.tolist(), places
        x, nx, places = self.of_length[k]
        for at in range(bisect_left(x, alo), len(x)):
            if x[at] + k > ahi:
                return None
            found = places[nx[at]]
            j = bisect_left(found, blo)
            if j < len(found) and found[j] + k <= bhi:
                return x[at], found[j]
        return None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def matched(first: str, second: str) -> int:
    """Characters in the matching blocks of two texts."""
    if not first or not second:
        return 0
    a, b = _codes(first), _codes(second)
    runs = _Runs(a, b)
    total = 0
    todo = [(0, len(a), 0, len(b), runs.longest())]
    while todo:
        alo, ahi, blo, bhi, k = todo.pop()
        k = min(k, ahi - alo, bhi - blo)
        hit = None
        while k and (hit := runs.first(k, alo, ahi, blo, bhi)) is None:
            k -= 1
        i, j = hit or (alo, blo)
        size = k
        while i > alo and j > blo and first[i - 1] == second[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and first[i + size] == second[j + size]:
            size += 1
        total += size
        if k:  # without a block to start from, what is left and right has none either
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, k - 1))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi, k))
    return total


def ratio(first: str, second: str) -> float:
    """Twice the matched characters over all characters; 1 for two empty texts."""
    both = len(first) + len(second)
    return 2.0 * matched(first, second) / both if both else 1.0
