"""Suffix orders of many short texts at once, by linear grouping construction.

Suffixes start in groups by their first symbol. Groups are taken in descending order; each of their suffixes points to
the nearest earlier position in a lower group, its previous smaller suffix, and the positions pointed at
move to higher groups of their own, those pointed at more often above the others. In the end a group holds the
suffixes with one Lyndon prefix, and groups stand in lexicographic order. Then the order is emitted from the
smallest suffix on: behind each suffix follow, along the pointers, those that it is the next smaller
suffix of, each to the front of its group. Nothing is renamed or solved recursively.

Pointers are found by following those of finished suffixes, which skips each of them once; suffixes of one group that meet
each other follow one another in doubling steps. The members of a group lie side by side in one array, and those
that move change places with its last ones, so no step reads more than the suffixes it handles.

The steps of all texts run side by side in numpy, on flat arrays: cell 1 + row * n + i is position i of a row, cell 0 and the
last cell of each row end every walk to the left.
"""

from __future__ import annotations

import numpy as np


def suffix_orders(texts: np.ndarray) -> np.ndarray:
    """Suffix array of each row of ``texts``, whose last symbol must be the only 0 of its row."""
    rows, n = texts.shape
    group, above = _groups(texts)
    return _emit(group, above, rows, n)


def _groups(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slot of each cell's group, and the cell of its previous smaller suffix (a last cell if there is none)."""
    rows, n = texts.shape
    symbols = int(texts.max()) + 1
    kind = (np.arange(rows, dtype=np.int64)[:, None] * symbols + texts).ravel()
    count = np.bincount(kind, minlength=rows * symbols)
    first = np.cumsum(count) - count
    group = np.append(-1, first[kind])
    size = np.zeros(rows * n, dtype=np.int64)
    size[first[count > 0]] = count[count > 0]
    member = np.argsort(kind, kind="stable") + 1
    slot = np.zeros(rows * n + 1, dtype=np.int64)
    slot[member] = np.arange(rows * n)
    above = np.arange(-1, rows * n)
    moving = np.zeros(rows * n + 1, dtype=bool)
    bottom = np.arange(rows, dtype=np.int64) * n + 1
    end = bottom + n - 1
    live = end > bottom
    while live.any():
        if not live.all():
            bottom, end = bottom[live], end[live]
        start = group[member[end - 1]]
        own, cell = _members(start, end, member)
        pointed = _point(own, cell, group, above)
        end = start
        live = end > bottom
        # The last cells stand in the first slot of their row and never move.
        pointed = pointed[(pointed - 1) % n != n - 1] if n > 1 else pointed[:0]
        if len(pointed):
            _move(pointed, group, size, member, slot, moving)
    return group, above


def _members(start: np.ndarray, end: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = end - start
    total = int(length.sum())
    if total == len(start):
        return start, member[start]
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)
    return np.repeat(start, length), member[at]


def _point(own: np.ndarray, cell: np.ndarray, group: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Previous smaller suffixes of the cells of the present groups ``own``, also stored in ``above``."""
    to = cell - 1
    there = group[to]
    far = (there > own).nonzero()[0]
    while len(far):
        step = above[to[far]]
        to[far] = step
        now = group[step]
        there[far] = now
        far = far[now > own[far]]
    above[cell] = to
    # Those that stopped at a suffix of their own group take over its pointer.
    same = (there == own).nonzero()[0]
    while len(same):
        step = above[to[same]]
        to[same] = step
        above[cell[same]] = step
        same = same[group[step] == own[same]]
    return to


def _move(pointed: np.ndarray, group: np.ndarray, size: np.ndarray, member: np.ndarray, slot: np.ndarray, moving: np.ndarray) -> None:
    """Move the cells pointed at to the end of their groups, as groups by how often they are pointed at."""
    pointed = np.sort(pointed)
    edge = np.flatnonzero(np.append(True, pointed[1:] != pointed[:-1]))
    cell, often = pointed[edge], np.diff(np.append(edge, len(pointed)))
    home = group[cell]
    order = np.lexsort((often, home))
    cell, often, home = cell[order], often[order], home[order]
    new_home = np.append(True, home[1:] != home[:-1])
    new_kind = np.append(True, new_home[1:] | (often[1:] != often[:-1]))
    at_home, at_kind = new_home.nonzero()[0], new_kind.nonzero()[0]
    moved = np.diff(np.append(at_home, len(cell)))
    tail = (home[at_home] + size[home[at_home]] - moved)[np.cumsum(new_home) - 1]
    to = tail + np.arange(len(cell)) - np.repeat(at_home, moved)
    size[home[at_home]] -= moved
    size[to[at_kind]] = np.diff(np.append(at_kind, len(cell)))
    moving[cell] = True
    there = member[to]
    there = there[~moving[there]]
    moving[cell] = False
    left = slot[cell]
    left = left[left < tail]
    member[left], slot[there] = there, left
    member[to], slot[cell] = cell, to
    group[cell] = to[at_kind][np.cumsum(new_kind) - 1]


def _emit(group: np.ndarray, above: np.ndarray, rows: int, n: int) -> np.ndarray:
    last = np.arange(1, rows + 1, dtype=np.int64) * n
    order = np.zeros(rows * n, dtype=np.int64)
    order[last - n] = last
    placed = np.zeros(rows * n + 1, dtype=bool)
    placed[0] = placed[last] = True
    front = np.arange(rows * n)
    at, end = last - n, last
    cell = last - 1
    while len(at):
        stop = placed[cell]
        go = (~stop).nonzero()[0]
        own = cell[go]
        home = group[own]
        to = front[home]
        order[to] = own
        front[home] = to + 1
        placed[own] = True
        cell[go] = above[own]
        stop = stop.nonzero()[0]
        if len(stop):
            now = at[stop] + 1
            at[stop] = now
            keep = now < end[stop]
            if keep.all():
                cell[stop] = order[now] - 1
            else:
                # These rows are complete.
                cell[stop[keep]] = order[now[keep]] - 1
                rest = at < end
                at, end, cell = at[rest], end[rest], cell[rest]
    return ((order - 1) % n).reshape(rows, n).astype(np.int32)
