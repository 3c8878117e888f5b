"""Suffix arrays by linear grouping of suffixes.

First suffixes are grouped by their first symbol, groups in order. Groups are then processed from the highest to the
lowest: every member points to the nearest suffix before it in a lower group; the suffixes pointed to get the group's
Lyndon prefix appended (once per pointer), so they leave their group for a new one just above it, those with most
pointers highest. At the end two suffixes share a group if and only if their longest Lyndon prefixes are equal, and
groups are in the order of these prefixes. A second pass over the array from its smallest suffix emits each group's order
front to back, following the same pointers; nothing is renamed and there is no recursion.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """Group (its first place in the array) of every suffix, and the pointers; the last symbol must be the unique smallest."""
    n = len(s)
    symbols = np.asarray(s)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, np.diff(symbols[order]) != 0]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    group = np.empty(n, np.int64)
    place = np.empty(n, np.int64)
    group[order], place[order] = first, np.arange(n)
    size = np.bincount(first, minlength=n).tolist()
    order, group, place = order.tolist(), group.tolist(), place.tolist()
    before = [-1] * n
    top = n - 1
    while top >= 0:
        g = group[order[top]]
        if g == top:  # one member
            i = order[top]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                h = group[j]
                k = size[h]
                if k > 1:
                    end = h + k - 1
                    a, b = place[j], order[end]
                    order[a], place[b] = b, a
                    order[end], place[j] = j, end
                    size[h], size[end], group[j] = k - 1, 1, end
            top -= 1
            continue
        count: dict[int, int] = {}
        for i in sorted(order[g : top + 1]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        by: dict[int, list[int]] = {}
        for j, k in count.items():
            by.setdefault(k, []).append(j)
        for k in sorted(by, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by[k]:
                moved.setdefault(group[j], []).append(j)
            for h, own in moved.items():
                if len(own) == size[h]:
                    continue
                end = h + size[h]
                for j in own:
                    end -= 1
                    a, b = place[j], order[end]
                    order[a], place[b] = b, a
                    order[end], place[j] = j, end
                size[h] -= len(own)
                size[end] = len(own)
                for j in own:
                    group[j] = end
        top = g - 1
    return group, before


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer sequence in ascending order (a shorter suffix is below its extensions)."""
    if not len(s):
        return np.empty(0, np.int64)
    s = [*np.asarray(s).tolist(), int(np.min(s)) - 1]
    group, before = lyndon_groups(s)
    n = len(s)
    front, placed, out = list(range(n)), bytearray(n), [0] * n
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = front[g]
            out[at], front[g], placed[j] = j, at + 1, 1
            j = before[j]
    return np.array(out[1:], np.int64)
