"""Suffix arrays of many small texts at once, by linear grouping.

First, suffixes are grouped by their longest Lyndon prefix. Groups begin as the suffixes of
one first symbol and are gone through in descending order. For a group's suffixes, the
nearest earlier suffix of a lower group is found over previous-smaller pointers; such
suffixes go on with this group's prefix once or more often, and move behind the rest of
their own group, the more often the further. A group that is reached is final.

Then orders are emitted in ascending order: a suffix that has its final place puts the one
before it, and those that its previous-smaller pointers lead to, at the front of their groups.
No text is renamed and nothing is sorted again.

Both passes are loops over single suffixes by nature. Here all texts of a batch make the same
step together, as one array operation, so a step costs the same for one text or thousands.
"""

from __future__ import annotations

import numpy as np

END, GAP, FIRST = 0, 1, 2


def join(problems: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bases, sizes): each problem's texts, a ``GAP`` after each and an ``END`` after the last; one ``END`` before all."""
    raw = b"".join(b"\0" + b"\0".join(texts) + b"\0" for texts in problems) + b"\0"
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16) + FIRST
    lengths = [np.array([len(t) + 1 for t in texts], np.int64) for texts in problems]
    sizes = np.array([int(n.sum()) + 1 for n in lengths], np.int64)
    bases = np.cumsum(sizes) - sizes + 1
    gaps = np.concatenate([b + np.cumsum(n) - 1 for b, n in zip(bases, lengths, strict=True)])
    symbols[gaps] = GAP
    symbols[0], symbols[bases + sizes - 1] = END, END
    return symbols, bases, sizes


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)


def suffix_arrays(symbols: np.ndarray, bases: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffixes of each problem in order, at the places of the problem; ``symbols`` as from ``join``."""
    total = len(symbols)
    problem = np.repeat(np.arange(len(bases), dtype=np.int64), sizes)
    key = np.concatenate(([-1], problem * (FIRST + 256) + symbols[1:]))
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], np.diff(key[order]) != 0))
    heads = np.flatnonzero(first)
    members = np.zeros(total, np.int64)  # of the group whose first place it is
    members[heads] = np.diff(np.append(heads, total))
    group, place = np.empty(total, np.int64), np.empty(total, np.int64)
    group[order] = np.repeat(heads, members[heads])
    place[order] = np.arange(total)
    before = np.arange(-1, total - 1)  # previous-smaller pointers; the suffix before it until its group is reached
    moves = np.zeros(total, bool)

    bottom, top = bases.copy(), bases + sizes
    while len(bottom):
        head = group[order[top - 1]]
        live = head > bottom
        if not live.all():
            bottom, top, head = bottom[live], top[live], head[live]
            if not len(bottom):
                break
        rows = order[_ranges(head, top)]
        own = np.repeat(head, top - head)
        at = rows - 1
        going = np.flatnonzero(group[at] >= own)
        while len(going):
            at[going] = before[at[going]]
            going = going[group[at[going]] >= own[going]]
        before[rows] = at
        top = head
        at = at[symbols[at] != END]
        if len(at):
            _move_up(np.sort(at), order, place, group, members, moves)

    out = np.empty(total, np.int64)
    out[bases] = bases + sizes - 1
    front = np.arange(total)
    placed = np.zeros(total, bool)
    by_size = np.argsort(-sizes, kind="stable")
    starts, ends = bases[by_size], sizes[by_size]
    n = len(starts)
    for i in range(int(ends[0]) if n else 0):
        while n and ends[n - 1] <= i:
            n -= 1
        at = out[starts[:n] + i] - 1
        while True:
            at = at[(symbols[at] != END) & ~placed[at]]
            if not len(at):
                break
            own = group[at]
            out[front[own]] = at
            front[own] += 1
            placed[at] = True
            at = before[at]
    return out


def _move_up(at: np.ndarray, order: np.ndarray, place: np.ndarray, group: np.ndarray, members: np.ndarray, moves: np.ndarray) -> None:
    """Each of ``at`` (sorted, repeated as often as it is met) moves behind the rest of its group, the more often the further."""
    new = np.concatenate(([True], at[1:] != at[:-1]))
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(at)))
    at = at[begin]
    own = group[at]
    by = np.argsort(own, kind="stable") if times.max() == 1 else np.lexsort((times, own))
    at, own, times = at[by], own[by], times[by]
    new_group = np.concatenate(([True], own[1:] != own[:-1]))
    begin = np.flatnonzero(new_group)
    moved = np.diff(np.append(begin, len(at)))
    old = own[begin]
    low = np.repeat(old + members[old] - moved, moved)
    slots = low + np.arange(len(at)) - np.repeat(begin, moved)
    part = np.flatnonzero(new_group | np.concatenate(([True], times[1:] != times[:-1])))
    many = np.diff(np.append(part, len(at)))
    moves[at] = True
    there = order[slots]
    pushed, holes = there[~moves[there]], place[at]
    holes = holes[holes < low]
    order[holes], place[pushed] = pushed, holes
    order[slots], place[at] = at, slots
    moves[at] = False
    members[old] -= moved
    members[slots[part]] = many
    group[at] = np.repeat(slots[part], many)


def equal_windows(symbols: np.ndarray, suffixes: np.ndarray, full: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, class of each) of the windows of ``length`` symbols that another window of their problem equals.

    full: whether the window at a place lies within one text.
    """
    rows = suffixes[1:][full[suffixes[1:]]]
    if len(rows) < 2:
        return rows[:0], rows[:0]
    raw = (symbols - FIRST).astype(np.uint8)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    pair = np.arange(len(rows) - 1)
    for shift in [length - 8, *range(0, length - 8, 8)]:
        pair = pair[eight[rows[pair] + shift] == eight[rows[pair + 1] + shift]]
    same = np.zeros(len(rows) + 1, bool)
    same[pair + 1] = True  # equal to the one before it in order
    some = same[:-1] | same[1:]
    return rows[some], np.cumsum(~same[:-1])[some]
