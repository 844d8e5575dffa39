"""Suffix arrays by linear grouping (Lyndon prefixes), in two phases.

Phase 1 groups suffixes by their Lyndon prefixes. It starts with one group for each symbol and visits the
groups in descending order. For each suffix of the visited group it finds the nearest position before it
that lies in a group not yet visited: its previous-smaller pointer. The Lyndon prefix of that position is
followed there by a copy of the visited group's prefix, so such positions leave their group for a new one
right above it; with more copies, higher.

Phase 2 fills the order from the smallest suffix on: when suffix i has its place, i - 1 and then the
positions its pointers lead to take the next free place of their groups. No group is renamed or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """The starts of the suffixes of s in ascending order; a suffix that is a prefix of another one comes first."""
    n = len(s)
    if not n:
        return []
    members: list[list[int]] = [[n]]  # position n is the empty suffix, in the lowest group
    of = {c: k + 1 for k, c in enumerate(sorted(set(s)))}
    members += [[] for _ in of]
    group = [of[c] for c in s]
    group.append(0)
    slot = [0] * (n + 1)
    for i in range(n):
        m = members[group[i]]
        slot[i] = len(m)
        m.append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    free = list(range(n + 1))  # free[i + 1] leads to the nearest unvisited position at or before i, plus 1
    free.append(n + 1)
    pointer = [-1] * (n + 1)
    order: list[int] = []
    g = len(members) - 1
    while g >= 0:
        now = members[g]
        order.append(g)
        for i in now:
            free[i + 1] = i
        if len(now) == 1:
            i = now[0]
            p = i
            while free[p] != p:
                free[p] = free[free[p]]
                p = free[p]
            if p:
                p -= 1
                pointer[i] = p
                r = group[p]
                old = members[r]
                if len(old) > 1:
                    k, last = slot[p], old.pop()
                    if last != p:
                        old[k] = last
                        slot[last] = k
                    new = len(members)
                    members.append([p])
                    group[p], slot[p] = new, 0
                    up = above[r]
                    below.append(r)
                    above.append(up)
                    above[r] = below[up] = new
            g = below[g]
            continue
        count: dict[int, int] = {}
        for i in now:
            p = i
            while free[p] != p:
                free[p] = free[free[p]]
                p = free[p]
            if p:
                p -= 1
                pointer[i] = p
                count[p] = count.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, c in count.items():
            by_count.setdefault(c, {}).setdefault(group[p], []).append(p)
        for c in sorted(by_count, reverse=True):
            for r, moved in by_count[c].items():
                old = members[r]
                if len(moved) == len(old):
                    continue
                new = len(members)
                for k, p in enumerate(moved):
                    j, last = slot[p], old.pop()
                    if last != p:
                        old[j] = last
                        slot[last] = j
                    group[p], slot[p] = new, k
                members.append(moved)
                up = above[r]
                below.append(r)
                above.append(up)
                above[r] = below[up] = new
        g = below[g]
    start = [0] * len(members)
    at = 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out = [-1] * (n + 1)
    placed = [False] * (n + 1)
    out[0], placed[n] = n, True
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = True
            j = pointer[j]
    return out[1:]
