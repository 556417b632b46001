"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix: groups start as equal first symbols and are processed in
descending order; every suffix points to its previous smaller suffix (the nearest to its left in a
lower group), and the suffixes pointed at from a group are split off to the upper end of theirs, those
with more pointers above those with fewer. Afterwards each group's order is emitted in one ascending
pass over the finished part of the array, following the same pointers. Nothing is renamed and no
recursion is made; time is linear up to the sorting of positions inside groups.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of non-negative ``symbols`` (a shorter suffix sorts before its extensions)."""
    text = [s + 1 for s in symbols] + [0]
    n = len(text)
    place = sorted(range(n), key=text.__getitem__)  # suffixes, group after group
    at = [0] * n      # index in place
    group = [0] * n   # a group's name is the index of its first place
    size = [0] * n
    first = 0
    for i, s in enumerate(place):
        at[s] = i
        if i and text[s] != text[place[i - 1]]:
            first = i
        group[s] = first
        size[first] += 1
    smaller = [-1] * n
    end = n
    while end:
        g = group[place[end - 1]]
        if end - g == 1:
            i = place[g]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0 and size[h := group[p]] > 1:  # alone, p leaves for the end of its group
                last = h + size[h] - 1
                other, was = place[last], at[p]
                place[was], at[other] = other, was
                place[last], at[p] = p, last
                size[h] -= 1
                group[p], size[last] = last, 1
            end = g
            continue
        pointed: dict[int, int] = {}
        for i in sorted(place[g:end]):
            p = i - 1
            while p >= 0 and group[p] > g:
                p = smaller[p]
            if p >= 0 and group[p] == g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = g
        by_count: dict[int, list[int]] = {}
        for p, c in pointed.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[c]:
                moved.setdefault(group[p], []).append(p)
            for h, ps in moved.items():
                if len(ps) == size[h]:
                    continue
                last = h + size[h]
                for p in ps:
                    last -= 1
                    other, was = place[last], at[p]
                    place[was], at[other] = other, was
                    place[last], at[p] = p, last
                size[h] -= len(ps)
                size[last] = len(ps)
                for p in ps:
                    group[p] = last
    out = [-1] * n
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    nxt = list(range(n))  # next free place of each group
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[nxt[g]] = p
            nxt[g] += 1
            done[p] = True
            p = smaller[p]
    return out[1:]
