"""Suffix arrays by linear grouping construction.

Suffixes are grouped by their longest Lyndon prefix. Groups are worked off in descending order; of each suffix of a
group, the previous suffix in a smaller group is found along previous-smaller pointers, and those are set apart in
their own group: what follows them is now known to be this group's prefix, once or several times over. When all
groups are final, one pass in ascending order emits the suffixes of each group in order: the suffix before a sorted
one, and on along the pointers, take the next place of their groups. Nothing is renamed or solved recursively.
"""

from __future__ import annotations

from itertools import accumulate


def suffix_array(text: list[int]) -> list[int]:
    """Starts of all suffixes of text (integers >= 1, of any alphabet) in ascending order."""
    t = [*text, 0]  # the end is smaller than all
    n = len(t)
    group, place, array, count = _by_first(t)
    smaller = [-2] * n
    top = n - 1
    while top >= 0:
        low = group[array[top]]
        if low == top:
            i = array[top]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[i] = p
            if p >= 0 and count[group[p]] > 1:
                _set_apart([p], group, place, array, count)
        else:
            _group_pass(array[low : top + 1], low, group, place, array, count, smaller)
        top = low - 1
    return _emit(n, group, smaller)


def _by_first(t: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups by first symbol: group (start of a suffix's group), place (in array), array (suffixes by group), count (by start)."""
    n = len(t)
    array = sorted(range(n), key=t.__getitem__)
    group, place, count = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(array):
        if t[i] != t[array[start]]:
            start = at
        group[i], place[i] = start, at
        count[start] += 1
    return group, place, array, count


def _group_pass(members: list[int], low: int, group: list[int], place: list[int], array: list[int], count: list[int], smaller: list[int]) -> None:
    """A group of several suffixes: their previous smaller ones are set apart, those with more members after them higher."""
    times: dict[int, int] = {}
    for i in members:
        if smaller[i] == -2:
            chain, p = [i], i - 1
            while p >= 0 and group[p] >= low:
                if smaller[p] == -2:  # of this group as well: it shares the result
                    chain.append(p)
                    p -= 1
                else:
                    p = smaller[p]
            for c in chain:
                smaller[c] = p
        p = smaller[i]
        if p >= 0:
            times[p] = times.get(p, 0) + 1
    by_times: dict[int, list[int]] = {}
    for p, k in times.items():
        by_times.setdefault(k, []).append(p)
    for k in sorted(by_times, reverse=True):
        _set_apart(by_times[k], group, place, array, count)


def _set_apart(some: list[int], group: list[int], place: list[int], array: list[int], count: list[int]) -> None:
    """Moves suffixes to the end of their groups and makes them groups of their own there."""
    moved: dict[int, int] = {}
    for p in some:
        start = group[p]
        m = moved.get(start, 0)
        last = start + count[start] - 1 - m
        at, other = place[p], array[last]
        array[at], array[last] = other, p
        place[other], place[p] = at, last
        moved[start] = m + 1
    for start, m in moved.items():
        size = count[start]
        new = start + size - m
        count[start] = size - m
        count[new] = m
        if new != start:
            for at in range(new, start + size):
                group[array[at]] = new


def _emit(n: int, group: list[int], smaller: list[int]) -> list[int]:
    """The order within groups; the end of the text comes first and is left out."""
    free = list(range(n))  # next free place of the group that starts here
    done = bytearray(n)
    order = [0] * n
    order[0] = n - 1
    done[n - 1] = 1
    for at in range(n):
        j = order[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = smaller[j]
    return order[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place of the suffix array the length that its suffix shares with the one before it (first: 0)."""
    n = len(order)
    rank = [0] * n
    for at, i in enumerate(order):
        rank[i] = at
    out = [0] * n
    h = 0
    for i in range(n):
        at = rank[i]
        if at:
            j = order[at - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[at] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def concatenated(rows: list[list[int]]) -> tuple[list[int], list[int]]:
    """Rows of integers >= 0 as one text, each ended by a separator of its own, and where each row begins."""
    k = len(rows)
    text: list[int] = []
    for r, row in enumerate(rows):
        text.extend(x + k + 1 for x in row)
        text.append(r + 1)
    return text, [0, *accumulate(len(row) + 1 for row in rows)][:-1]
