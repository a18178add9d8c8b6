"""Deep-shallow sorting of suffixes of one bounded block, in vectorised steps.

Shallow: multikey quicksort over eight-byte characters to a depth of SHALLOW bytes; equal keys stay together
as a group. Deep: blind tries order each group that is left. A trie of a group grows from one of its suffixes,
the leaf that all others are compared with; each branches off where its common prefix with that leaf ends, and
suffixes that branch off at one place by one byte form the group of the branch, which grows on from there.
All tries of a block grow together, one path a round.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there on as one big-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out[: len(data)] |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _heads(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def sort_windows(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): ``starts[order]`` sorted by their ``depth`` bytes; same[k]: equal to the one before it.

    Every start has ``depth`` bytes of its own in ``data``; depth is a multiple of 8.
    """
    n = len(starts)
    words = eight_bytes(data)
    order = np.argsort(words[starts], kind="stable")
    key = words[starts[order]]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    level, shallow = 8, min(SHALLOW, depth)
    while level < shallow:  # multikey quicksort: only within groups of equal keys
        group = _heads(new)
        tied = np.zeros(n, bool)
        tied[1:] |= ~new[1:]
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        key = words[starts[order[rows]] + level]
        again = np.lexsort((key, group[rows]))
        order[rows] = order[rows][again]
        key, own = key[again], group[rows][again]
        new[rows[1:]] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        new[rows[0]] = True
        level += 8
    same = ~new
    if level < depth:
        same = _blind_tries(words, starts, order, new, level, depth)
    return order, same


def _blind_tries(words, starts, order, new, known: int, depth: int) -> np.ndarray:
    """Sort groups that agree on ``known`` bytes, in place; returns which rows equal the row before them."""
    same = np.zeros(len(order), bool)
    tied = np.zeros(len(order), bool)
    tied[1:] |= ~new[1:]
    tied[:-1] |= ~new[1:]
    rows = np.flatnonzero(tied)
    group = _heads(new)[rows]
    at_word = np.full(len(rows), known // 8, np.int64)  # whole words that the group agrees on
    top = depth // 8
    while len(rows):
        first = np.ones(len(rows), bool)
        first[1:] = group[1:] != group[:-1]
        head = _heads(first)
        member = order[rows]
        a, b = starts[member], starts[member[head]]
        # common words with the group's leaf, for all members at once
        common = at_word.copy()
        live = np.flatnonzero(~first)
        while len(live):
            equal = words[a[live] + 8 * common[live]] == words[b[live] + 8 * common[live]]
            live = live[equal]
            common[live] += 1
            live = live[common[live] < top]
        whole = common == top
        whole[first] = True
        at = np.where(whole, 0, common)
        x, y = words[a + 8 * at], words[b + 8 * at]
        less = ~whole & (x < y)
        # order of the trie: smaller branches from the shallowest on, the leaf and its equals, larger from the deepest on
        side = np.where(whole, 1, np.where(less, 0, 2))
        place = np.where(whole, 0, np.where(less, common, -common))
        branch = np.where(whole, np.uint64(0), x)
        again = np.lexsort((branch, place, side, group))
        order[rows] = member[again]
        group, side, place, branch, common, whole = group[again], side[again], place[again], branch[again], common[again], whole[again]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (place[1:] != place[:-1]) | (branch[1:] != branch[:-1])
        same[rows] = ~fresh & whole
        group = rows[_heads(fresh)]
        size = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1]
        ends = ~whole & (common + 1 >= top)  # agree on the branch word, which is the last one
        same[rows[ends & ~fresh]] = True
        on = ~whole & ~ends & (size > 1)
        rows, group, at_word = rows[on], group[on], common[on] + 1
    return same
