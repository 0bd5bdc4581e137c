"""Suffix order of integer sequences by linear grouping.

The construction has two phases.  Phase one sorts suffixes into groups by their Lyndon prefix, the longest prefix that is smaller than all
its own proper suffixes.  Groups are handled from the largest to the smallest.  Each member of the handled group finds, by pointers to
previous smaller places, the place in front that its Lyndon prefix extends.  Such a place leaves its group for a new one just above it;
places that the handled group extends more often go further up.  A handled group never changes again, so nothing is renamed twice.

Phase two emits the order.  Every group owns a stretch of the result.  Going through the result from its start, the place before each
suffix, and from there the chain of previous smaller places, are the next in their own groups: each group's order comes from what is
already emitted, without comparing or renaming anything.
"""

from __future__ import annotations

import numpy as np


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order.  The last value must be smaller than all others."""
    n = len(values)
    if n < 2:
        return np.arange(n)
    group, smaller, start = _lyndon_groups(values)
    # every group is filled from its start
    order, placed = [-1] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for at in range(n):
        j = order[at] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            own = group[j]
            order[start[own]] = j
            start[own] += 1
            j = smaller[j]
    return np.array(order)


def _lyndon_groups(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Final group and previous smaller place of every place; start of every group in the result."""
    n = len(values)
    by_value = np.argsort(values, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(values[by_value]) != 0])
    sizes = np.diff(np.r_[heads, n])
    members = [part.tolist() for part in np.split(by_value, heads[1:])]
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]  # neighbours in the order of groups
    start, alive = [0] * len(members), sizes.tolist()
    numbers = np.empty(n, np.int64)
    numbers[by_value] = np.repeat(np.arange(len(members)), sizes)
    group, smaller, handled = numbers.tolist(), [-1] * n, bytearray(n)
    free, at = n, len(members) - 1

    def move(old: int, places: list[int]) -> None:
        """Takes places out of their group into a new one just above it."""
        fresh, higher = len(members), above[old]
        members.append(places)
        below.append(old)
        above.append(higher)
        start.append(0)
        alive.append(len(places))
        alive[old] -= len(places)
        above[old] = fresh
        below[higher] = fresh
        for j in places:
            group[j] = fresh

    while at >= 0:
        if not alive[at]:
            at = below[at]
            continue
        own = [i for i in members[at] if group[i] == at]  # what has moved on is still listed
        members[at] = ()
        free -= len(own)
        start[at] = free
        if len(own) == 1:
            i = own[0]
            handled[i] = 1
            j = i - 1
            while j >= 0 and handled[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and alive[group[j]] > 1:
                move(group[j], [j])
            at = below[at]
            continue
        own.sort()
        for i in own:
            handled[i] = 1
        extended: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and handled[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                extended[j] = extended.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in extended.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (_, old), places in sorted(moves.items()):  # those extended most often first, the others get between
            if len(places) < alive[old]:  # a whole group need not move
                move(old, places)
        at = below[at]
    return group, smaller, start
