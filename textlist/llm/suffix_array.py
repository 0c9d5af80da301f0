"""Suffix arrays by linear grouping: Lyndon-prefix groups in descending order, then each group's order.

Suffixes start in groups by their first symbol. The groups are taken from the highest down; every suffix of a group
points to the nearest suffix before it whose group is lower (its previous smaller), and the
suffixes pointed at move up within their own group, those pointed at more often further. When all groups are done, a group
holds the suffixes with one Lyndon prefix. A single pass over the ranks in ascending order then deals the suffixes to the
places of their groups along the same pointers; nothing is renamed or sorted again.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order; a proper prefix sorts first."""
    n = len(symbols) + 1  # with an end symbol below all others
    order = sorted(range(n - 1), key=symbols.__getitem__)
    order.insert(0, n - 1)
    place, group = [0] * n, [0] * n  # of each suffix: its index in order, and where its group begins there
    end = [0] * (n + 1)  # of each group, by where it begins
    first = last = -1
    for i, s in enumerate(order):
        place[s] = i
        now = -1 if s == n - 1 else symbols[s]
        if i == 0 or now != last:
            first, last = i, now
        group[s] = first
        end[first] = i + 1
    before = [-1] * n  # previous smaller suffix

    top = n
    while top > 0:
        start = group[order[top - 1]]
        if top - start == 1:
            s = order[start]
            j = s - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[s] = j
            if j >= 0:  # moves up alone
                g = group[j]
                e = end[g]
                if e - g > 1:
                    p, other = place[j], order[e - 1]
                    order[p], place[other] = other, p
                    order[e - 1], place[j] = j, e - 1
                    group[j], end[e - 1], end[g] = e - 1, e, e - 1
            top = start
            continue
        times: dict[int, int] = {}
        for s in sorted(order[start:top]):  # in text order, so that pointers within the group are there to be followed
            j = s - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[s] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in times.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            parts: dict[int, list[int]] = {}
            for j in by_count[k]:
                parts.setdefault(group[j], []).append(j)
            for g, moved in parts.items():
                e = end[g]
                if e - g == len(moved):
                    continue
                for j in moved:  # to the tail of their group
                    e -= 1
                    p, other = place[j], order[e]
                    order[p], place[other] = other, p
                    order[e], place[j] = j, e
                for j in moved:
                    group[j] = e
                end[e], end[g] = end[g], e
        top = start

    ranks, free = [-1] * n, list(range(n))  # free: the next place of the group that begins there
    ranks[0] = n - 1
    for i in range(n):
        s = ranks[i] - 1
        while s >= 0:
            g = group[s]
            if place[s] < 0:  # dealt already
                break
            ranks[free[g]] = s
            free[g] += 1
            place[s] = -1
            s = before[s]
    return ranks[1:]

