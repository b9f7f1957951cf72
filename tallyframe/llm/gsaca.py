"""Suffix sorting by linear grouping.

First the suffixes are grouped by their Lyndon prefixes: groups are processed from the highest to the lowest,
and each sends the places of its members' previous smaller suffixes into new groups right above their own,
those with more such members higher. Then the array is filled from the left: every suffix that has its final
place emits its left neighbour, and that neighbour's chain of previous smaller suffixes, at the head of
their groups. Nothing is renamed and nothing is solved recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start places of all suffixes of a sequence of integers, in lexicographic order (a prefix comes first)."""
    n = len(symbols)
    if n == 0:
        return []
    order, head, size, where, group = _by_first_symbol(symbols)
    before = _lyndon_groups(n, order, head, size, where, group)
    return _emit(n, group, before)


def _by_first_symbol(symbols):
    """Places ordered by symbol; each place's slot and group, groups named by their first slot."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    where, group, size = [0] * n, [0] * n, [0] * n
    head = last = None
    for slot, place in enumerate(order):
        if symbols[place] != last:
            head, last = slot, symbols[place]
        where[place], group[place] = slot, head
        size[head] += 1
    return order, head, size, where, group


def _lyndon_groups(n, order, top, size, where, group) -> list[int]:
    """Refines `group` in place until it orders suffixes by Lyndon prefix; returns the previous smaller places (-1: none)."""
    before = [-1] * n
    slot = top
    while True:
        count = size[slot]
        members = sorted(order[slot : slot + count]) if count > 1 else (order[slot],)
        sent: dict[int, int] = {}
        for place in members:
            j = place - 1
            while j >= 0 and group[j] >= slot:
                j = before[j]
            before[place] = j
            if j >= 0:
                sent[j] = sent.get(j, 0) + 1
        if len(sent) == 1:
            (place,) = sent
            _move(((place,),), order, size, where, group)
        elif sent:
            levels: dict[int, list[int]] = {}
            for place, times in sent.items():
                levels.setdefault(times, []).append(place)
            for times in sorted(levels, reverse=True):
                parts: dict[int, list[int]] = {}
                for place in levels[times]:
                    parts.setdefault(group[place], []).append(place)
                _move(parts.values(), order, size, where, group)
        if slot == 0:
            return before
        slot = group[order[slot - 1]]


def _move(parts, order, size, where, group) -> None:
    """Puts each part, members of one group, into a new group right above what is left of the old one."""
    for part in parts:
        old = group[part[0]]
        if size[old] == len(part):
            continue
        end = old + size[old]
        for place in part:
            end -= 1
            slot, other = where[place], order[end]
            order[slot], where[other] = other, slot
            order[end], where[place] = place, end
        size[old] -= len(part)
        size[end] = len(part)
        for place in part:
            group[place] = end


def _emit(n, group, before) -> list[int]:
    """Final order from Lyndon groups: the empty suffix comes first and emits the last place's chain."""
    out = [-1] * n
    done = [False] * n
    free = list(range(n))  # next free slot of the group that starts here
    current = n
    slot = -1
    while True:
        place = current - 1
        while place >= 0 and not done[place]:
            head = group[place]
            out[free[head]] = place
            free[head] += 1
            done[place] = True
            place = before[place]
        slot += 1
        if slot == n:
            return out
        current = out[slot]
