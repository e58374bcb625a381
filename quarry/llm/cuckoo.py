"""Cuckoo filter whose buckets are 64-bit words of four 16-bit fingerprints.

Python builds and updates filters; Catalyst expressions probe them, one array element a bucket.
"""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS, BITS = 4, 16
MASK = (1 << BITS) - 1
#: Odd multiplier that spreads a fingerprint over bucket numbers; small enough for signed longs.
SPREAD = 0x5BD1E995
KICKS = 500
LOAD = 0.8


class CuckooFilter:
    """Set of 64-bit keys with insertion and deletion; no false negatives."""

    def __init__(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.slots = [[0] * SLOTS for _ in range(buckets)]
        self.random = random.Random(buckets)

    @classmethod
    def of(cls, keys: list[int]) -> CuckooFilter:
        """A filter of all keys, doubled until they fit."""
        buckets = 1
        while buckets * SLOTS * LOAD < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    def _spots(self, key: int) -> tuple[int, int, int]:
        key &= (1 << 64) - 1
        print_ = (key & MASK) or 1
        mask = len(self.slots) - 1
        first = (key >> BITS) & mask
        return print_, first, first ^ (print_ * SPREAD >> 8 & mask)

    def insert(self, key: int) -> bool:
        """False if there was no room; the filter is then without one of its keys: build it anew."""
        f, a, b = self._spots(key)
        for spot in (a, b):
            if 0 in self.slots[spot]:
                self.slots[spot][self.slots[spot].index(0)] = f
                return True
        at, mask = self.random.choice((a, b)), len(self.slots) - 1
        for _ in range(KICKS):
            j = self.random.randrange(SLOTS)
            f, self.slots[at][j] = self.slots[at][j], f
            at ^= f * SPREAD >> 8 & mask
            if 0 in self.slots[at]:
                self.slots[at][self.slots[at].index(0)] = f
                return True
        return False

    def delete(self, key: int) -> bool:
        """Remove one copy of a key that was inserted."""
        f, a, b = self._spots(key)
        for spot in (a, b):
            if f in self.slots[spot]:
                self.slots[spot][self.slots[spot].index(f)] = 0
                return True
        return False

    def __contains__(self, key: int) -> bool:
        f, a, b = self._spots(key)
        return f in self.slots[a] or f in self.slots[b]

    def words(self) -> list[int]:
        packed = [sum(f << (BITS * j) for j, f in enumerate(s)) for s in self.slots]
        return [w - (1 << 64) if w >> 63 else w for w in packed]

    @classmethod
    def from_words(cls, words: list[int]) -> CuckooFilter:
        made = cls(len(words))
        made.slots = [[(w >> (BITS * j)) & MASK for j in range(SLOTS)] for w in words]
        return made


def may_contain(words: Column, start: Column, buckets: Column, key: Column) -> Column:
    """Whether the filter of ``buckets`` words from ``start`` on may hold the key: two array reads."""
    low = key.bitwiseAND(F.lit(MASK).cast("long"))
    f = F.when(low == 0, F.lit(1).cast("long")).otherwise(low)
    mask = buckets - 1
    first = F.shiftrightunsigned(key, BITS).bitwiseAND(mask)
    second = first.bitwiseXOR(F.shiftright(f * F.lit(SPREAD).cast("long"), 8).bitwiseAND(mask))

    def holds(spot: Column) -> Column:
        word = F.get(words, (start + spot).cast("int"))
        found = [F.shiftrightunsigned(word, BITS * j).bitwiseAND(F.lit(MASK).cast("long")) == f for j in range(SLOTS)]
        return found[0] | found[1] | found[2] | found[3]

    return holds(first) | holds(second)
