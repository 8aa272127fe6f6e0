"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are processed in descending order: for
each member the previous suffix of a smaller group is found by following pointers, and the suffixes
found move, by how many members point to them, into new groups just above their old ones. Once all
groups are final, suffixes are emitted in ascending order: each one that is emitted places those
that end where it begins, so groups are ordered without renaming symbols.
"""

from __future__ import annotations


import numpy as np


def suffix_array(text: list[int] | np.ndarray) -> list[int]:
    """Starts of the suffixes of a sequence of non-negative integers, in order; a proper prefix comes first."""
    text = np.asarray(text)
    n = len(text)
    if n == 0:
        return []
    group, previous, size = _lyndon_groups(text)
    return _emitted(n, group, previous, size)


def _lyndon_groups(text: np.ndarray) -> tuple[list[int], list[int], dict[int, int]]:
    """For each suffix its group, named by the rank of its first member, and the nearest suffix to the left in a lower group (-1: none); sizes by group."""
    n = len(text)
    # a stable sort of 16-bit symbols counts them
    by = np.argsort(text.astype(np.uint16) if text.max() < 1 << 16 else text, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], text[by][1:] != text[by][:-1]]))
    counts = np.diff(np.append(heads, n))
    place, first = np.empty(n, np.int64), np.empty(n, np.int64)
    place[by], first[by] = np.arange(n), np.repeat(heads, counts)
    order, place, group = by.tolist(), place.tolist(), first.tolist()
    size = dict(zip(heads.tolist(), counts.tolist(), strict=True))
    previous = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:  # one member
            s = order[end]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                _lifted(p, order, place, group, size)
        else:
            members = sorted(order[start : end + 1])
            counts: dict[int, int] = {}
            for s in members:
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            if len(counts) == 1:
                _lifted(next(iter(counts)), order, place, group, size)
            elif counts:
                _raised(counts, order, place, group, size)
        end = start - 1
    return group, previous, size


def _lifted(p: int, order: list[int], place: list[int], group: list[int], size: dict[int, int]) -> None:
    """Moves a suffix to the end of its group, as a group of its own."""
    g = group[p]
    k = size[g]
    if k > 1:
        last = g + k - 1
        other, at = order[last], place[p]
        order[at], order[last] = other, p
        place[other], place[p] = at, last
        size[g] = k - 1
        size[last] = 1
        group[p] = last


def _raised(counts: dict[int, int], order: list[int], place: list[int], group: list[int], size: dict[int, int]) -> None:
    """Moves each group's counted suffixes to its end, those with higher counts further up, as groups of their own."""
    by_count: dict[int, list[int]] = {}
    for p, c in counts.items():
        by_count.setdefault(c, []).append(p)
    for c in sorted(by_count, reverse=True):
        moved: dict[int, int] = {}
        for p in by_count[c]:
            g = group[p]
            k = moved.get(g, 0)
            last = g + size[g] - 1 - k
            moved[g] = k + 1
            other, at = order[last], place[p]
            order[at], order[last] = other, p
            place[other], place[p] = at, last
        for g, k in moved.items():
            if k == size[g]:
                continue
            fresh = g + size[g] - k
            size[g] -= k
            size[fresh] = k
            for at in range(fresh, fresh + k):
                group[order[at]] = fresh


def _emitted(n: int, group: list[int], previous: list[int], size: dict[int, int]) -> list[int]:
    out = [0] * n
    free = {g: g for g in size}
    done = bytearray(n)
    for at in range(-1, n):
        s = (out[at] if at >= 0 else n) - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = previous[s]
    return out
