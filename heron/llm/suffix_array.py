"""Suffix arrays by induced sorting, vectorised in waves of the scan."""

from __future__ import annotations

import numpy as np


#: Places of a scan up to which a wave isn't worth its fixed work.
SHORT = 48


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their right neighbour; past the end stands a smallest symbol."""
    n = len(t)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    smaller = np.zeros(n, bool)
    smaller[:-1] = t[:-1] < t[1:]
    # equal neighbours take the class of the next place where symbols differ
    at = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return smaller[at]


def _dealt(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the rank of each within its symbol, and the distinct symbols with their counts."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(first, append=len(ordered))
    return order, np.arange(len(ordered)) - np.repeat(first, counts), ordered[first], counts


def _scanned(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, free: np.ndarray, step: int) -> None:
    """The scan of induced sorting: each suffix in sa, in order, puts the one before it at the free place of its bucket.

    `wanted` tells the suffixes to be put, `free` the next free place of each bucket, step 1 fills buckets forwards and
    scans from the left, -1 backwards and from the right. The scan goes in waves: as many places at once as none of
    their own suffixes goes to. Small alphabets take about a wave a bucket, large ones about the root of the length.
    """
    n = len(sa)
    at, size = 0, 2 * SHORT
    line = sa if step > 0 else sa[::-1]  # a view, in the order of the scan
    while at < n:
        before = line[at : at + size] - 1
        sends = np.flatnonzero(before >= 0)
        sends = sends[wanted[before[sends]]]
        if not len(sends):
            at += len(before)
            continue
        places = before[sends]
        goes = free[t[places]]  # or further on
        goes = goes if step > 0 else n - 1 - goes
        least = np.minimum.accumulate(goes)
        # up to the first place that one before it in the wave goes to
        late = np.flatnonzero(least[:-1] <= at + sends[1:])
        stop = int(least[late[0]] - at) if len(late) else min(len(before), int(least[-1] - at))
        count = int(np.searchsorted(sends, stop))
        places = places[:count]
        if count == 1:
            c = t[places[0]]
            sa[free[c]] = places[0]
            free[c] += step
        elif count:
            order, rank, symbols, counts = _dealt(t[places])
            sa[np.repeat(free[symbols], counts) + step * rank] = places[order]
            free[symbols] += step * counts
        at += stop
        if stop < SHORT:  # a few places one by one, then a wave is tried again
            for k in range(at, min(n, at + SHORT)):
                i = line[k] - 1
                if i >= 0 and wanted[i]:
                    c = t[i]
                    sa[free[c]] = i
                    free[c] += step
            at += SHORT
        size = min(1 << 16, max(2 * SHORT, 2 * stop))


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes that follows from the order of the leftmost-smaller ones."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    ends = np.cumsum(np.bincount(t, minlength=size))
    begins = np.concatenate([[0], ends[:-1]])
    if len(lms):  # they stand at the ends of their buckets, in order
        order, rank, symbols, counts = _dealt(t[lms])
        sa[np.repeat(ends[symbols] - counts, counts) + rank] = lms[order]
    free = begins.copy()
    # the last suffix is larger than what follows it, and nothing puts it
    sa[free[t[n - 1]]] = n - 1
    free[t[n - 1]] += 1
    _scanned(sa, t, ~small, free, 1)
    _scanned(sa, t, small, ends - 1, -1)
    return sa


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring in `ordered`, equal for equal ones, rising with their order."""
    n = len(t)
    length = np.diff(lms, append=n - 1) + 1  # a substring reaches to the next such place, or the end
    of = np.zeros(n, np.int32)
    of[lms] = length
    a, b = ordered[:-1], ordered[1:]
    same = (of[a] == of[b]) & (a != lms[-1]) & (b != lms[-1])
    alive = np.flatnonzero(same)
    step = 0
    while len(alive):
        alive = alive[step < of[a[alive]]]
        x, y = a[alive] + step, b[alive] + step
        equal = (t[x] == t[y]) & (small[x] == small[y])
        same[alive[~equal]] = False
        alive = alive[equal]
        step += 1
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of t (symbols below size) in order.

    Classify suffixes, sort the leftmost-smaller substrings by one induction and name them, sort the string of names
    by another such pass if names repeat, and induce all suffixes linearly.
    """
    n = len(t)
    if n <= 1:
        return np.arange(n, dtype=np.int32)
    small = classify(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        sa = _induce(t, small, lms, size)
        ordered = sa[is_lms[sa]]
        names = _names(t, small, lms, ordered)
        if names[-1] + 1 < len(lms):
            place = np.empty(n, np.int32)
            place[ordered] = names
            ordered = lms[suffix_array(place[lms], int(names[-1]) + 1)]
        lms = ordered
    return _induce(t, small, lms, size)


def words(t: np.ndarray) -> np.ndarray:
    """For every place, its 8 bytes as a number; zeros beyond the end."""
    padded = np.concatenate([t.astype(np.uint8), np.zeros(8, np.uint8)])
    out = np.zeros(len(t), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(t)].astype(np.uint64)
    return out


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By place in t: the common prefix with the suffix before it in sa, in bytes, up to `most`."""
    n = len(t)
    out = np.zeros(n, np.int16 if most < 1 << 15 else np.int32)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    eight = words(t)
    alive = np.flatnonzero(before >= 0)
    step = 0
    while len(alive) and step < most:
        x, y = alive + step, before[alive] + step
        inside = (x < n) & (y < n)
        alive, x, y = alive[inside], x[inside], y[inside]
        differ = eight[x] ^ eight[y]
        equal = differ == 0
        part = differ[~equal]
        lead = np.zeros(len(part), np.int64)
        for k in range(1, 8):
            lead += (part >> np.uint64(64 - 8 * k)) == 0
        # zeros beyond the end may look alike: a prefix can't be longer than the rest of either text
        rest = n - np.maximum(x, y)
        out[alive[~equal]] = np.minimum(most, step + np.minimum(lead, rest[~equal]))
        out[alive[equal]] = np.minimum(most, step + np.minimum(8, rest[equal]))
        alive = alive[equal]
        step += 8
    return out
