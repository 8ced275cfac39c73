"""Linear-time suffix sorting by grouping (no recursion, no renaming).

Phase 1 refines groups of suffixes, starting from their first symbols, in
descending order. For the highest group not yet handled, every member's pointer
goes to the nearest suffix before it that is in a lower group; what lies between
belongs to the member's Lyndon word, so pointers of handled suffixes jump over
it. The suffixes pointed at are moved, by how many members point at them, into
new groups directly above their old ones. Phase 2 fills the order from the front:
the suffix before a placed one takes the next place of its group, then the suffix
its pointer names, and so on until one is already placed."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order. The last symbol
    must be smaller than all others."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = np.asarray(symbols)[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size_at = np.zeros(n + 1, np.int64)
    size_at[head] = np.diff(np.concatenate((head, [n])))
    begin = np.repeat(head, size_at[head])
    start = np.empty(n, np.int64)
    start[order] = begin
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    order, start, place, size = order.tolist(), start.tolist(), place.tolist(), size_at.tolist()
    before = [-1] * n

    top = n
    while top > 0:
        low = start[order[top - 1]]
        group = order[low:top]
        if len(group) > 1:
            group.sort()
        counts: dict[int, int] = {}
        for i in group:
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            if len(counts) == 1 or max(counts.values()) == 1:
                levels = {1: list(counts)}
            else:
                levels = {}
                for p, c in counts.items():
                    levels.setdefault(c, []).append(p)
            for c in sorted(levels, reverse=True):
                by_group: dict[int, list[int]] = {}
                for p in levels[c]:
                    by_group.setdefault(start[p], []).append(p)
                for g, members in by_group.items():
                    k = len(members)
                    left = size[g] - k
                    if not left:
                        continue
                    at = g + left                 # the group's last places
                    end = at
                    inside = set(members)
                    free = [order[x] for x in range(at, at + k) if order[x] not in inside]
                    for p in members:
                        if place[p] < at:         # change places with one that stays
                            q = free.pop()
                            a, b = place[p], place[q]
                            order[a], order[b] = q, p
                            place[p], place[q] = b, a
                        start[p] = end
                    size[g] = left
                    size[end] = k
        top = low

    out = [-1] * n
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    nxt = list(range(n))
    nxt[start[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[nxt[g]] = j
            nxt[g] += 1
            done[j] = True
            j = before[j]
    return np.array(out, np.int64)
