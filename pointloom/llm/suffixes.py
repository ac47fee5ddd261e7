"""Suffix sorting and common extensions of integer sequences, in numpy. No Spark in here."""

from __future__ import annotations

import numpy as np


def heads(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from the one before."""
    return np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])


def suffix_ranks(keys: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in sorted order, ranks of the strings of 1, 2, 4 ... keys that start at each place), by prefix doubling.

    The rank of a string is the first slot of its group, so equal strings have equal ranks; strings that are found nowhere else leave the rounds.
    The last key must be unique. With a depth, suffixes are sorted by that many keys at least, and not always by more.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    first = heads(keys[order])
    slots = np.arange(n)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    levels, step = [rank], 1
    slots = slots[~(first & np.append(first[1:], True))]
    while len(slots) and (depth is None or step < depth):
        at = order[slots]
        pair = rank[at].astype(np.int64) * n + rank[at + step]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        first = heads(pair)
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        levels.append(rank)
        slots = slots[~(first & np.append(first[1:], True))]
        step *= 2
    return order, levels


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """Lengths of the common extensions of places i and j, which differ: of what begins there, or of what ends there."""
    size = np.zeros(len(i), np.int64)

    def grow(which: np.ndarray, k: int) -> np.ndarray:
        """Lengthen those whose next 2^k words agree; which did."""
        a, b = (i[which] - size[which] - (1 << k) + 1, j[which] - size[which] - (1 << k) + 1) if back else (i[which] + size[which], j[which] + size[which])
        same = (levels[k][a] == levels[k][b]) & (np.minimum(a, b) >= 0)
        size[which[same]] += 1 << k
        return same

    left, ended = np.arange(len(i)), []
    for k in range(len(levels)):
        same = grow(left, k)
        ended.append(left[~same])
        left = left[same]
        if not len(left):
            break
    left = np.zeros(0, np.int64)
    for k in range(len(ended) - 1, 0, -1):
        left = np.concatenate([left, ended[k]])
        grow(left, k - 1)
    return size
