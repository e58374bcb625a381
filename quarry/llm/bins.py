"""Bin packing of a histogram of lengths by bin completion with branch and bound.

Lengths are integers from 1 to the capacity, so any number of pieces is a histogram of at most
``capacity`` counts. The search takes the largest open length and enumerates the fillings beside it that
no other filling dominates, those that waste least first. A filling dominates another if the other's
items, some of them put together, fit into the places of its own items. Branches are cut where the waste
passes what the incumbent (the better of best fit and least waste) leaves, where the rest needs too many bins, and where a
bin has been tried before in the same place. One filling is used for as many bins at once as its lengths
allow, and bin by bin on the way back, so nothing is left out: the search ends with the proof that the
incumbent is optimal, or after ``steps`` steps, which is its only limit. ``Plan.bound`` tells how far
from optimal such a plan may be.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

#: Steps (items tried in fillings) of one search: some five to ten seconds of the driver's time.
STEPS = 1_500_000
#: Steps that an incumbent may take to find one filling.
PATIENCE = 2000
#: Open lengths up to which a branch's own lower bound is computed.
SHORT = 64

Items = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


class Plan(NamedTuple):
    bins: list[tuple[Items, int]]  # (items of a bin, bins of that kind)
    size: int
    bound: int
    proven: bool  # no plan has fewer bins


def _spread(bits: int, most: int) -> int:
    """Bits moved up by 0 to ``most``."""
    width = 1
    while width <= most:
        step = min(width, most + 1 - width)
        bits |= bits << step
        width += step
    return bits


class _Open:
    """Open counts by length, the lengths in order, and the same as bits."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)
        self.bits = sum(1 << k for k in self.n)

    def take(self, items: Items, times: int) -> None:
        for k, c in items:
            left = self.n[k] - c * times
            if left:
                self.n[k] = left
            else:
                del self.n[k]
                del self.lengths[bisect_left(self.lengths, k)]
                self.bits ^= 1 << k

    def give(self, items: Items, times: int) -> None:
        for k, c in items:
            if k not in self.n:
                insort(self.lengths, k)
                self.bits ^= 1 << k
            self.n[k] = self.n.get(k, 0) + c * times

    def times(self, items: Items) -> int:
        return min(self.n[k] // c for k, c in items)


def _best_filling(state: _Open, capacity: int) -> Items:
    """The largest item, and beside it always the largest that fits."""
    room, items = capacity, Counter[int]()
    while room > 0:
        at = bisect_right(state.lengths, room)
        while at and state.n[state.lengths[at - 1]] <= items[state.lengths[at - 1]]:
            at -= 1
        if not at:
            break
        k = state.lengths[at - 1]
        c = min(room // k, state.n[k] - items[k])
        items[k] += c
        room -= c * k
    return tuple(items.items())


def _filled(counts: dict[int, int], filling: Callable[[_Open], Items]) -> list[tuple[Items, int]]:
    """The plan that takes one filling after the other, each for as many bins as there are items for."""
    state, plan = _Open(counts), []
    while state.lengths:
        items = filling(state)
        times = state.times(items)
        state.take(items, times)
        plan.append((items, times))
    return plan


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Items, int]]:
    """Best fit decreasing."""
    return _filled(counts, lambda state: _best_filling(state, capacity))


def least_waste(counts: dict[int, int], capacity: int) -> list[tuple[Items, int]]:
    """Beside the largest item always the filling of least waste, or best fit where finding it takes more
    than ``PATIENCE`` steps."""

    def filling(state: _Open) -> Items:
        fillings.left = PATIENCE
        first = state.lengths[-1]
        return next(fillings.beside(state, first, capacity - first, capacity), (0, None))[1] or _best_filling(state, capacity)

    fillings = Fillings(counts, capacity, PATIENCE)
    return _filled(counts, filling)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The best of the volume bound and, over cuts, the bound that counts items too large to share."""
    if not counts:
        return 0
    lengths = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(k)] for k in lengths], dtype=np.int64)
    number, volume = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * lengths))
    half = int(np.searchsorted(lengths, capacity // 2, side="right"))
    cuts = np.arange(half)  # items from lengths[cut] on count
    large = np.searchsorted(lengths, capacity - lengths[:half], side="right")
    spare = (number[large] - number[half]) * capacity - (volume[large] - volume[half])
    over = np.maximum(0, volume[half] - volume[cuts] - spare)
    big = int(number[-1] - number[half])
    return max(-(-int(volume[-1]) // capacity), big, *(big + -(-over // capacity)).tolist(), 0)


class Fillings:
    """Undominated fillings, and the count of the steps that looking for them took."""

    def __init__(self, counts: dict[int, int], capacity: int, steps: int) -> None:
        self.left = steps
        self.mask = (1 << (capacity + 1)) - 1
        #: For each length the sums that open items of that length or less may have, as bits. Counts
        #: only fall during a search, so these sums always suffice.
        self.sums: dict[int, int] = {}
        sums = 1
        for k in sorted(counts):
            c, unit = min(counts[k], capacity // k), 1
            while c > 0:
                part = min(unit, c)
                sums |= sums << (part * k)
                c, unit = c - part, unit * 2
            self.sums[k] = sums = sums & self.mask

    def beside(self, state: _Open, first: int, room: int, most: int) -> Iterator[tuple[int, Items]]:
        """(waste, items) of fillings that waste ``most`` or less, ``first`` included, least waste first
        up to a factor of two."""
        low, high = -1, 0
        while low < min(most, room):
            yield from self._between(state, first, room, low, min(high, most))
            low, high = high, 2 * high + 1

    def _between(self, state: _Open, first: int, room: int, low: int, high: int) -> Iterator[tuple[int, Items]]:
        # a path of items, descending: (left, places to try from, used, sums of one item, of more, open)
        used = Counter({first: 1})
        spare = state.bits if state.n[first] > 1 else state.bits ^ (1 << first)
        stack = [(room, bisect_right(state.lengths, min(room, first)), 1, 0, spare)]
        path: list[int] = []
        if low < room <= high and not self._dominated(room, 1, 0, spare):
            yield room, ((first, 1),)
        while stack:
            left, at, one, more, spare = stack.pop()
            at = min(at, bisect_right(state.lengths, left))
            while at:
                k = state.lengths[at - 1]
                at -= 1
                if used[k] < state.n[k] and self._reaches(k, left - k, high):
                    break
            else:
                if path:
                    used[path.pop()] -= 1
                continue
            self.left -= 1
            if self.left <= 0:
                return
            stack.append((left, at, one, more, spare))
            more2 = more | ((more | (one ^ 1)) << k) & self.mask
            spare2 = spare if used[k] + 1 < state.n[k] else spare & ~(1 << k)
            # items put together that are as long as an open one: dominated, whatever comes after
            if more2 & spare2:
                continue
            used[k] += 1
            path.append(k)
            one2 = one | 1 << k
            if low < left - k <= high and not self._dominated(left - k, one2, more2, spare2):
                yield left - k, tuple(sorted(((j, c) for j, c in used.items() if c), reverse=True))
            stack.append((left - k, at + 1, one2, more2, spare2))

    def _reaches(self, k: int, left: int, waste: int) -> bool:
        """Whether items of length ``k`` or less may fill ``left`` but for ``waste``."""
        window = self.sums[k] & ((1 << (left + 1)) - 1)
        return window >> max(0, left - waste) != 0

    @staticmethod
    def _dominated(slack: int, one: int, more: int, spare: int) -> bool:
        """Whether an open item can take the place of items of the filling, alone or put together."""
        return bool((_spread(more, slack) | (_spread(one, slack - 1) << 1 if slack else 0)) & spare)


@dataclass
class _Frame:
    options: Iterator[tuple[int, Items]]
    tried: list[Items] = field(default_factory=list)
    items: Items | None = None
    waste: int = 0
    times: int = 0


def pack(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    """The bins of all pieces, each piece once."""
    counts = {k: n for k, n in counts.items() if n > 0}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths go from 1 to the capacity")
    bound = lower_bound(counts, capacity)
    for incumbent in (best_fit, least_waste):
        made = incumbent(counts, capacity)
        if incumbent is best_fit or sum(t for _, t in made) < size:
            best, size = made, sum(t for _, t in made)
        if size == bound:
            return Plan(best, size, bound, True)
    total = sum(k * n for k, n in counts.items())
    state, fillings = _Open(counts), Fillings(counts, capacity, steps)
    waste = used = 0
    barred = Counter[Items]()

    def frame(*tried: Items) -> _Frame:
        barred.update(tried)
        first = state.lengths[-1]
        return _Frame(fillings.beside(state, first, capacity - first, (size - 1) * capacity - total - waste), list(tried))

    stack = [frame()]
    while stack and size > bound and fillings.left > 0:
        top = stack[-1]
        if top.items is not None:  # what follows this filling is done
            state.give(top.items, 1)
            top.times, waste, used = top.times - 1, waste - top.waste, used - 1
            if top.times:
                stack.append(frame(top.items))
                continue
            top.tried.append(top.items)
            barred[top.items] += 1
            top.items = None
        lost, items = next(top.options, (0, None))
        if items is None:
            barred.subtract(stack.pop().tried)
            continue
        free = (size - 1) * capacity - total - waste
        if lost > free or barred[items] > 0:
            continue
        times = min(state.times(items), free // lost if lost else state.n[items[0][0]])
        state.take(items, times)
        top.items, top.waste, top.times = items, lost, times
        waste, used = waste + lost * times, used + times
        if not state.lengths:
            best, size = [(f.items, f.times) for f in stack if f.items is not None], used
        elif used + (lower_bound(state.n, capacity) if len(state.lengths) <= SHORT else 1) < size:
            stack.append(frame())
    proven = size == bound or fillings.left > 0
    return Plan(best, size, size if proven else bound, proven)
