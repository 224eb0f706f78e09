"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified, leftmost-smaller (LMS) suffixes are sorted by inducing once from any order, naming
the LMS substrings and sorting the string of names recursively, and a second induction sorts all. Induction
visits buckets in order; within a bucket it takes runs of entries at a time, which keeps the order that an
entry-by-entry scan has. Strings of names with more than WIDE symbols are sorted by doubling ranks instead,
as visiting so many buckets would cost more than it sorts.
"""

from __future__ import annotations

import numpy as np

WIDE = 2048


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` (whole numbers from 0), in order."""
    if len(text) < 2:
        return np.arange(len(text))
    closed = np.append(text.astype(np.int64) + 1, 0)  # a closing symbol below all others
    return _induced(closed)[1:]


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one."""
    step = np.sign(text[1:].astype(np.int32) - text[:-1])
    place = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(np.append(step, 1)[nearest] > 0, True)


def _induced(text: np.ndarray) -> np.ndarray:
    used = np.bincount(text) > 0  # names and bytes are small numbers
    n_symbols = int(used.sum())
    dense = (np.cumsum(used) - 1)[text]
    if n_symbols == len(text):
        return np.argsort(dense)
    if n_symbols > WIDE:
        return _doubled(dense)
    dense = dense.astype(np.uint16)  # stable sorts of 16-bit keys take linear time
    small = _smaller(dense)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(dense, minlength=n_symbols))
    rough = _induce(dense, small, lms[np.argsort(dense[lms], kind="stable")], ends)
    is_lms = np.zeros(len(dense), bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    name_of = np.zeros(len(dense), np.int64)
    name_of[order] = np.cumsum(np.append(False, ~_equal_substrings(dense, lms, order)))
    names = name_of[lms]
    inner = _induced(names) if names.max() + 1 < len(names) else np.argsort(names, kind="stable")
    return _induce(dense, small, lms[inner], ends)


def _equal_substrings(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each LMS substring equals the one before it in `order`."""
    length = np.zeros(len(text), np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    equal = length[a] == length[b]
    active, k = np.flatnonzero(equal), 0
    while len(active):
        differ = text[a[active] + k] != text[b[active] + k]
        equal[active[differ]] = False
        k += 1
        active = active[~differ & (length[a[active]] > k)]
    return equal


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that sorted LMS suffixes induce."""
    out = np.full(len(text), -1, np.int64)
    starts = np.append(0, ends[:-1])
    n_lms = np.bincount(text[lms], minlength=len(ends))
    first = np.cumsum(n_lms) - n_lms
    seeds = [lms[f : f + n] for f, n in zip(first, n_lms, strict=True)]

    head = starts.copy()

    def send(batch: np.ndarray, wanted: bool, free: np.ndarray, step: int) -> None:
        """Puts the predecessors of the wanted type into their buckets, in the batch's order."""
        before = batch[batch > 0] - 1
        before = before[small[before] == wanted]
        if not len(before):
            return
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        new = np.append(0, np.flatnonzero(symbol[1:] != symbol[:-1]) + 1)
        count = np.diff(np.append(new, len(symbol)))
        rank = np.arange(len(symbol)) - np.repeat(new, count)
        out[free[symbol] + step * rank] = before[order]
        free[symbol[new]] += step * count

    for c in range(len(ends)):
        done = starts[c]
        while done < head[c]:
            done, batch = head[c], out[done : head[c]].copy()
            send(batch, False, head, 1)
        send(seeds[c], False, head, 1)

    tail = ends - 1
    for c in range(len(ends) - 1, -1, -1):
        done = ends[c] - 1
        while done > tail[c]:
            done, batch = tail[c], out[tail[c] + 1 : done + 1][::-1].copy()
            send(batch, True, tail, -1)
        send(out[starts[c] : head[c]][::-1].copy(), True, tail, -1)
    out[0] = len(text) - 1
    return out


def _doubled(text: np.ndarray) -> np.ndarray:
    rank, step = text.astype(np.int64), 1
    while True:
        after = np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))
        both = rank * (len(rank) + 1) + after
        order = np.argsort(both)
        both = both[order]
        change = both[1:] != both[:-1]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.append(0, np.cumsum(change))
        if rank[order[-1]] == len(text) - 1:
            return order
        step *= 2


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, limit: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """For each start, in the text's order, the longest prefix shared with a neighbour in `order`, up to `limit`.

    With `wanted`, a mask of starts, only pairs of neighbours that are both wanted are compared.
    """
    padded = np.append(text.astype(np.int64), np.full(limit + 4, -1))  # symbols below 2 ** 15
    four = sum((padded[k : len(padded) - 3 + k] & 0xFFFF) << (16 * k) for k in range(4))
    a, b = order[:-1], order[1:]
    if wanted is not None:
        pairs = wanted[a] & wanted[b]
        a, b = a[pairs], b[pairs]
    common = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for table, step in ((four, 4), (padded, 1)):  # by fours, then what is left singly
        while True:
            at = common[active]
            active = active[at + step <= limit]
            at = common[active]
            same = (table[a[active] + at] == table[b[active] + at]) & (padded[a[active] + at + step - 1] >= 0)
            if step == 4:
                common[active[same]] += 4
                active = active[same]
                if not len(active):
                    active = np.arange(len(a))
                    break
            else:
                active = active[same]
                common[active] += 1
                if not len(active):
                    break
    out = np.zeros(len(text), np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out
