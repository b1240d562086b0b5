"""Suffix arrays of byte shards by induced sorting, and permuted common prefixes, in numpy.

The passes of induced sorting scan the array in order and put each suffix's predecessor into its
bucket. A stretch of the array can be taken at once as long as no predecessor lands within it, so
the scans here go by stretches, which are cut where one does.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the empty suffix at the end is the smallest)."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the letter changes
    return step[at] > 0


def _occurrence(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each letter came before in c; the distinct letters and their counts."""
    order = np.argsort(c, kind="stable")
    s = c[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(first, len(s)))
    occ = np.empty(len(c), np.int64)
    occ[order] = np.arange(len(c)) - np.repeat(first, count)
    return occ, s[first], count


def _scan(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, edge: np.ndarray, back: bool) -> None:
    """Induces suffixes of one type: forward from bucket heads, or backward from bucket tails."""
    n, p, size = len(sa), 0, 4096
    view = sa[::-1] if back else sa
    while p < n:
        q = min(n, p + size)
        part = view[p:q]
        src = np.flatnonzero(part > 0)
        j = part[src] - 1
        keep = wanted[j]
        src, j = src[keep], j[keep]
        size = min(2 * size, 1 << 17)
        if not len(j):
            p = q
            continue
        c = t[j]
        occ, letters, count = _occurrence(c)
        slot = edge[c] + occ
        if back:
            slot = (n - 1) - (edge[c] - occ)
        least = int(slot.min())
        if least < q:  # only the entries before the first landing are final
            k = int(np.searchsorted(src, least - p))
            size = max(64, 2 * (least - p))
            if k < len(j):
                j, c, slot = j[:k], c[:k], slot[:k]
                _, letters, count = _occurrence(c)
            q = least
        view[slot] = j
        edge[letters] += -count if back else count
        p = q


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    s = c[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    if len(s):
        sa[np.repeat(ends[s[first]] - count, count) + np.arange(len(s)) - np.repeat(first, count)] = lms[order]
    heads = starts.copy()
    sa[heads[t[n - 1]]] = n - 1  # what the empty suffix induces
    heads[t[n - 1]] += 1
    _scan(sa, t, ~is_s, heads, back=False)
    held = sa >= 0
    sa[held] = np.where(is_s[sa[held]], -1, sa[held])
    _scan(sa, t, is_s, ends - 1, back=True)
    return sa


def _names(t: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each LMS substring of the sorted order lms: equal substrings get the same."""
    n = len(t)
    by_place = np.sort(lms)
    length = np.empty(n, np.int64)
    length[by_place[:-1]] = np.diff(by_place) + 1
    length[by_place[-1]] = n + 1  # runs into the end: like no other
    a, b = lms[:-1], lms[1:]
    same = (length[a] == length[b]) & (length[a] <= n)
    left, off = np.flatnonzero(same), 0
    while len(left):
        left = left[length[a[left]] > off]
        equal = t[a[left] + off] == t[b[left] + off]
        same[left[~equal]] = False
        left, off = left[equal], off + 1
    names = np.concatenate([[0], np.cumsum(~same)])
    return names, int(names[-1]) + 1


def suffix_array(t: np.ndarray, letters: int = 256) -> np.ndarray:
    """The starts of all suffixes of t (integers 0..letters-1) in order; a shorter prefix comes first."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.uint16 if letters <= 1 << 16 else np.int64)
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    size = np.bincount(t, minlength=letters)
    ends = np.cumsum(size)
    starts = ends - size
    if len(lms) > 1:
        sa = _induce(t, is_s, lms, starts, ends)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        names, distinct = _names(t, order)
        if distinct < len(lms):
            named = np.empty(n, np.int64)
            named[order] = names
            order = lms[suffix_array(named[lms], distinct)]
        lms = order
    return _induce(t, is_s, lms, starts, ends)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the array, the common prefix of its suffix with the one before it.

    The prefixes are found in text order: where the letters before a suffix and its neighbour are
    equal, the value is that of the place before, less one; only the other places are compared.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    new = (phi <= 0) | (i == 0)
    rest = np.flatnonzero(~new)
    new[rest] = t[rest - 1] != t[phi[rest] - 1]
    at = np.flatnonzero(new & (phi >= 0))
    value = np.zeros(n, np.int64)
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    wide = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    left, a, b = at, at.copy(), phi[at]
    limit = n - np.maximum(a, b)
    off = 0
    while len(left):
        eight = (wide[np.minimum(a + off, n)] == wide[np.minimum(b + off, n)])
        run = np.where(eight.all(axis=1), 8, np.argmin(eight, axis=1))
        value[left] = np.minimum(off + run, limit)
        go = (run == 8) & (off + 8 < limit)
        left, a, b, limit = left[go], a[go], b[go], limit[go]
        off += 8
    start = np.maximum.accumulate(np.where(new, i, 0))
    permuted = np.maximum(value[start] - (i - start), 0)
    return permuted[sa]
