"""Suffix sorting inside one block of text: difference cover, one suffix bucket at a time.

Positions whose residue modulo ``V`` lies in the cover are ranked first. A
bucket of suffixes is then sorted by its first ``V`` bytes; suffixes that tie
there are compared by the ranks of two cover positions at one common shift,
which exists for any pair of residues. Memory is the ranks and one bucket.
"""

from __future__ import annotations

import numpy as np

V = 31
# A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
BUCKET = 1 << 18
_PAD = 160


def _shifts() -> np.ndarray:
    """For residues a, b the least shift that brings both into the cover."""
    member = np.zeros(V, bool)
    member[list(COVER)] = True
    table = np.full((V, V), -1, np.int64)
    for shift in reversed(range(V)):
        inside = member[(np.arange(V) + shift) % V]
        table[np.ix_(inside, inside)] = shift
    return table


SHIFT = _shifts()


class Block:
    def __init__(self, text: np.ndarray):
        """``text``: bytes as uint8."""
        padded = np.concatenate([text, np.zeros(_PAD, np.uint8)])
        n = len(text) + _PAD - 8
        words = np.zeros(n, np.uint64)
        for i in range(8):
            words |= padded[i:i + n].astype(np.uint64) << np.uint64(8 * (7 - i))
        self.words = words
        self.size = len(text)
        self.rank = self._cover_ranks()

    def keys(self, at: np.ndarray) -> list[np.ndarray]:
        """The first V bytes as big-endian words; the last one holds 7 bytes."""
        parts = [self.words[at + 8 * i] for i in range(4)]
        parts[3] = parts[3] >> np.uint64(8)
        return parts

    @staticmethod
    def _dense(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(order, dense rank in that order) of rows given by columns, first column first."""
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for x in columns:
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
        return order, np.cumsum(new)

    def _cover_ranks(self) -> np.ndarray:
        """Lexicographic ranks of the cover positions to a depth of 2 V bytes."""
        at = np.arange(self.size + V)
        at = at[np.isin(at % V, COVER)]
        rank = np.zeros(self.size + 3 * V, np.int64)
        order, dense = self._dense(self.keys(at))
        rank[at[order]] = dense + 1
        order, dense = self._dense([rank[at], rank[at + V]])
        deep = np.zeros_like(rank)
        deep[at[order]] = dense + 1
        return deep

    def _resolve(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sort each group of suffixes with equal first V bytes by cover ranks.

        All groups take a pivot at once and fall into less, equal and greater
        parts; the equal part is done.
        """
        at, group = at.copy(), group.copy()
        place = np.arange(len(at))
        while len(place):
            head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[head, len(group)])
            rows = at[place]
            pivot = np.repeat(rows[head + size // 2], size)
            shift = SHIFT[rows % V, pivot % V]
            order_of = np.sign(self.rank[rows + shift] - self.rank[pivot + shift])
            key = group * 3 + order_of + 1
            order = np.argsort(key, kind="stable")
            at[place] = rows[order]
            key = key[order]
            _, group, counts = np.unique(key, return_inverse=True, return_counts=True)
            open_ = (key % 3 != 1) & (counts[group] > 1)
            place, group = place[open_], group[open_]
        return at

    def sorted_buckets(self, starts: np.ndarray):
        """The suffixes at ``starts`` in lexicographic order, bucket by bucket."""
        first = (self.words[starts] >> np.uint64(40)).astype(np.int64)  # three bytes
        by = np.argsort(first, kind="stable")
        starts, first = starts[by], first[by]
        ends = np.flatnonzero(np.r_[first[1:] != first[:-1], True]) + 1
        low = 0
        while low < len(starts):
            high = int(ends[min(np.searchsorted(ends, low + BUCKET), len(ends) - 1)])
            bucket = starts[low:high]
            order, dense = self._dense(self.keys(bucket))
            bucket = bucket[order]
            size = np.bincount(dense)
            tied = size[dense] > 1
            if tied.any():
                bucket[tied] = self._resolve(bucket[tied], dense[tied])
            yield bucket
            low = high


def repeated_elsewhere(text: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """Of suffixes ``starts`` those whose first ``length`` bytes also start with a smaller owner.

    The bytes of neighbours in suffix order are compared, so the result does
    not rest on hashes. ``length`` is 32 to 2 * V.
    """
    block = Block(text)
    owner_of = np.zeros(len(text), np.int64)
    owner_of[starts] = owners
    found = []
    steps = [*range(0, length - 8, 8), length - 8]
    for bucket in block.sorted_buckets(starts):
        new = np.zeros(len(bucket), bool)
        new[0] = True
        for step in steps:
            words = block.words[bucket + step]
            new[1:] |= words[1:] != words[:-1]
        head = np.flatnonzero(new)
        owner = owner_of[bucket]
        least = np.minimum.reduceat(owner, head)
        found.append(bucket[owner > np.repeat(least, np.diff(np.r_[head, len(bucket)]))])
    return np.concatenate(found) if found else np.zeros(0, np.int64)
