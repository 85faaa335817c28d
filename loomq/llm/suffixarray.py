"""Suffix arrays by linear grouping.

First phase: suffixes are grouped by their longest Lyndon prefix. Groups, kept as ranges of
one array, are processed in descending order. Each member points to the nearest earlier
suffix of a lower group (its previous smaller one, found along the pointers of those
between); what it points to has a Lyndon prefix that the group's prefix extends, so it moves
to a new group right after its old one, those with more pointers further up.

Second phase: in ascending order, each placed suffix lets the suffixes along the pointers
from its left neighbour take the next free place of their group. No ranks are renamed and
nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> list[int]:
    """The places of all suffixes of symbols, in ascending order; a proper prefix comes before what it begins.

    symbols: integers of any size. An empty sequence has an empty array.
    """
    values = np.asarray(symbols, np.int64)
    if not len(values):
        return []
    _, dense = np.unique(values, return_inverse=True)
    text = np.append(dense + 1, 0)  # a last symbol below all others
    n = len(text)
    order_np = np.argsort(text, kind="stable")
    counts = np.bincount(text)
    starts = np.cumsum(counts) - counts
    order = order_np.tolist()
    place_np = np.empty(n, np.int64)
    place_np[order_np] = np.arange(n)
    place = place_np.tolist()
    group = starts[text].tolist()
    size_np = np.zeros(n, np.int64)
    size_np[starts] = counts
    size = size_np.tolist()
    before = _group(order, place, group, size)
    return _emit(n, group, before)[1:]


def _group(order: list[int], place: list[int], group: list[int], size: list[int]) -> list[int]:
    """The first phase, in place; returns the pointers to the previous smaller suffix, -1 for none."""
    before = [-1] * len(order)
    end = len(order)
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            j = order[start] - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[order[start]] = j
            if j >= 0 and size[old := group[j]] > 1:
                _move(j, old, order, place, size)
                size[old] -= 1
                new = old + size[old]
                size[new] = 1
                group[j] = new
            end = start
            continue
        pointers: dict[int, int] = {}
        for i in sorted(order[start:end]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in pointers.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[k]:
                old = group[j]
                m = moved.get(old, 0)
                _swap(j, old + size[old] - 1 - m, order, place)
                moved[old] = m + 1
            for old, m in moved.items():
                if m == size[old]:
                    continue
                size[old] -= m
                new = old + size[old]
                size[new] = m
                for x in range(new, new + m):
                    group[order[x]] = new
        end = start
    return before


def _swap(j: int, to: int, order: list[int], place: list[int]) -> None:
    at, other = place[j], order[to]
    order[at], order[to] = other, j
    place[other], place[j] = at, to


def _move(j: int, old: int, order: list[int], place: list[int], size: list[int]) -> None:
    """To the end of its group."""
    _swap(j, old + size[old] - 1, order, place)


def _emit(n: int, group: list[int], before: list[int]) -> list[int]:
    """The second phase."""
    out, free, placed = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out


def repeated_windows(raw: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each of the places `starts`, whether the width symbols from there on also begin at another of them.

    No window may reach over the end of raw. Neighbours in the suffix array are compared symbol by symbol.
    """
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    rank = np.empty(len(raw), np.int64)
    rank[np.asarray(suffix_array(raw), np.int64)] = np.arange(len(raw))
    order = np.argsort(rank[starts], kind="stable")
    windows = np.lib.stride_tricks.sliding_window_view(raw, width)
    same = np.zeros(len(starts) + 1, bool)
    for a in range(0, len(starts) - 1, 1 << 16):
        at = starts[order[a : a + (1 << 16) + 1]]
        same[a + 1 : a + len(at)] = (windows[at[1:]] == windows[at[:-1]]).all(1)
    out = np.zeros(len(starts), bool)
    out[order] = same[1:] | same[:-1]
    return out
