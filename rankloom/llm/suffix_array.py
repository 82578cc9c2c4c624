"""Suffix arrays of byte strings by two-stage sorting, to a fixed depth.

Suffixes smaller than their successors are sorted directly: the stretch from each such position to
the next gets a rank, and ranks of neighbouring stretches are combined, doubling the depth each time, for
ties only. All other suffixes are induced by one pass over the buckets of first bytes. Adjacent
suffixes are then compared to get their common prefixes. Everything is array work on one batch.
"""

from __future__ import annotations

import numpy as np

SYMBOL_BITS = 10
SYMBOLS = 6


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is greater than the empty suffix."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def direct_order(t: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The positions where `small` holds, sorted by their suffixes up to `depth` bytes at least."""
    at = np.flatnonzero(small)
    n = len(at)
    if n < 2:
        return at
    length = np.append(np.diff(at) + 1, len(t) - at[-1] + 1)  # the last one ends with the end of the text
    # Bytes with their kind, so that no stretch is another's prefix; 0 past the end.
    symbol = np.concatenate((t.astype(np.int64) * 2 + small + 1, np.zeros(SYMBOLS, np.int64)))

    def word(which: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for j in range(k * SYMBOLS, (k + 1) * SYMBOLS):
            inside = j < length[which]
            out = (out << SYMBOL_BITS) | np.where(inside, symbol[np.minimum(at[which] + j, len(t))], 0)
        return out

    rank = np.zeros(n, np.int64)
    tied = np.arange(n)

    def refine(tied: np.ndarray, key: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Split groups of equal rank by `key`, given their order by rank and key; returns those still tied.

        A rank is the place of its group's first member, so only tied ones ever change.
        """
        who, k = tied[order], key[order]
        r = rank[who]
        place = np.arange(len(who))
        new_group = np.concatenate(([True], r[1:] != r[:-1]))
        new_part = new_group | np.concatenate(([True], k[1:] != k[:-1]))
        group = np.maximum.accumulate(np.where(new_group, place, 0))
        part = np.maximum.accumulate(np.where(new_part, place, 0))
        rank[who] = r + part - group
        return who[~(new_part & np.concatenate((new_part[1:], [True])))]

    key = word(tied, 0)
    tied = refine(tied, key, np.argsort(key, kind="stable"))
    k = 1
    while len(deep := np.flatnonzero(length[tied] > k * SYMBOLS)):  # tied ones are equally long as far as they are equal
        rest, deep = np.delete(tied, deep), tied[deep]
        key = word(deep, k)
        tied = np.concatenate((rest, refine(deep, key, np.lexsort((key, rank[deep])))))
        k += 1
    steps = 1
    while len(tied):
        after = np.minimum(tied + steps, n)
        key = np.append(rank + 1, 0)[after]  # 0: the text ends there
        tied = refine(tied, key, np.argsort(rank[tied] * (n + 2) + key))
        steps *= 2
        reach = np.append(at, at[-1] + depth)[np.minimum(tied + steps, n)]
        tied = tied[reach - at[tied] < depth]
    return at[np.argsort(rank, kind="stable")]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `t` (bytes) in the order of their suffixes, exact up to `depth` bytes."""
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    small = smaller_than_next(t)
    first = direct_order(t, small, depth)
    size = np.bincount(t, minlength=256)
    n_small = np.bincount(t[first], minlength=256)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    end = begin + size
    out = np.empty(n, np.int64)
    taken = 0
    for c in np.flatnonzero(n_small).tolist():
        out[end[c] - n_small[c] : end[c]] = first[taken : taken + n_small[c]]
        taken += n_small[c]
    head = begin.copy()

    def induce(found: np.ndarray) -> None:
        """Put the greater-than-next predecessors of `found` at the heads of their buckets, in order."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        if not before.size:
            return
        c = t[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        cuts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = c[a]
            out[head[k] : head[k] + b - a] = before[a:b]
            head[k] += b - a

    induce(np.array([n]))
    for c in np.flatnonzero(size).tolist():
        done = begin[c]
        while done < head[c]:  # a run of one byte fills its own bucket step by step
            stop = head[c]
            induce(out[done:stop])
            done = stop
        induce(out[end[c] - n_small[c] : end[c]])
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int, rows: int = 4096) -> np.ndarray:
    """Length up to `depth` of the common prefix of each of `order` with the next; all must have `depth` bytes."""
    view = np.lib.stride_tricks.sliding_window_view(t, depth)
    out = np.empty(max(0, len(order) - 1), np.int64)
    for i in range(0, len(out), rows):
        block = view[order[i : i + rows + 1]]
        same = block[1:] == block[:-1]
        out[i : i + rows] = np.where(same.all(1), depth, same.argmin(1))
    return out
