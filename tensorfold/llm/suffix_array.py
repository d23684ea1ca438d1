"""Suffix arrays by linear grouping: suffixes are grouped by their longest Lyndon prefix, highest group first, then placed.

First part: groups are taken from the highest down. Each suffix of the group points to the previous suffix in a lower group
(its previous smaller suffix); suffixes pointed to so and so often have that many more copies of the group's Lyndon word in
their own, and move to a new group just above their old one. Second part: suffixes are visited in order, and each one is followed by
those for which it is the next smaller suffix, each put at the next free place of its group. Names are given once, to
the symbols; nothing is renamed or recursed into. (U. Baier, Linear-time suffix sorting, CPM 2016.)
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """Of each suffix, the start of its group in the order and its previous smaller suffix (-1: none). The text's last symbol must be its only smallest."""
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable")
    ranked = np.asarray(text)[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(heads, n))
    group_np, size_np, place_np = np.empty(n, np.int64), np.zeros(n + 1, np.int64), np.empty(n, np.int64)
    group_np[order] = np.repeat(heads, sizes)
    size_np[heads] = sizes
    place_np[order] = np.arange(n)
    order, place, group, size = order.tolist(), place_np.tolist(), group_np.tolist(), size_np.tolist()
    before = [-1] * n
    end = n
    while end > 0:
        head = group[order[end - 1]]
        times: dict[int, int] = {}
        if end - head == 1:
            s = order[head]
            p = s - 1
            while p >= 0 and group[p] >= head:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = 1
        else:
            for s in sorted(order[head:end]):
                p = s - 1
                while p >= 0 and group[p] >= head:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
        end = head
        if not times:
            continue
        if len(times) == 1 or max(times.values()) == 1:
            turns = [list(times)]
        else:
            by: dict[int, list[int]] = {}
            for p, c in times.items():
                by.setdefault(c, []).append(p)
            turns = [by[c] for c in sorted(by, reverse=True)]
        for moved in turns:
            for p in moved:
                g = group[p]
                left = size[g] - 1
                size[g] = left
                last = g + left
                at = place[p]
                if at != last:
                    q = order[last]
                    order[at], place[q] = q, at
                    order[last], place[p] = p, last
            heads_new = [group[p] + size[group[p]] for p in moved]
            for p, g in zip(moved, heads_new, strict=True):
                group[p] = g
                size[g] += 1
    return group, before


def suffix_array(symbols) -> np.ndarray:
    """Starts of the suffixes of a sequence of whole numbers in ascending order; a shorter suffix comes before those that it begins."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64) - int(np.min(symbols)) + 1, 0).tolist()
    group, before = lyndon_groups(text)
    out = [0] * (n + 1)
    out[0] = n
    free = list(range(n + 1))  # by a group's head: its next free place
    for k in range(n + 1):
        i = out[k]
        j, stop = i - 1, before[i]
        while j != stop:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
    return np.asarray(out[1:], np.int64)
