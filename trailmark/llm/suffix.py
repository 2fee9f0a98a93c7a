"""Suffix arrays by induced sorting, a bucket at a time, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from .vec import BASE, Powers, Rolling

_POW = Powers(BASE)


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one is larger than the empty suffix."""
    n = len(t)
    up, same = t[:-1] < t[1:], t[:-1] == t[1:]
    at = np.where(same, n - 1, np.arange(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    out[:-1] = np.append(up, False)[at]
    return out


class _Buckets:
    """Places of suffixes by first symbol; ``push`` appends a batch, keeping its order, in each bucket."""

    def __init__(self, t: np.ndarray, k: int, step: int):
        counts = np.bincount(t, minlength=k)
        ends = np.cumsum(counts)
        self.t, self.k, self.step = t, k, step
        self.at = (ends - counts) if step > 0 else ends - 1
        self.sa = np.full(len(t), -1, np.int64)

    def push(self, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        symbols = self.t[suffixes]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        counts = np.bincount(symbols, minlength=self.k)
        rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[symbols]
        self.sa[self.at[symbols] + self.step * rank] = suffixes[order]
        self.at += self.step * counts


def _chain(t: np.ndarray, found: np.ndarray, c: int) -> np.ndarray:
    """``found`` and, after it, those induced inside its own bucket: predecessors with the same symbol, again and again."""
    parts, edge = [found], found
    while len(edge):
        edge = edge[edge > 0] - 1
        edge = edge[t[edge] == c]
        if len(edge):
            parts.append(edge)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def induce(t: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order from leftmost-smaller suffixes ``lms`` in order (of their substrings, or in full)."""
    n = len(t)
    symbol_of = t[lms]
    order = np.argsort(symbol_of, kind="stable")
    lms_by = lms[order]
    cut = np.searchsorted(symbol_of[order], np.arange(k + 1))
    counts = np.bincount(t, minlength=k)
    heads = np.cumsum(counts) - counts
    large = _Buckets(t, k, 1)
    large.push(np.array([n - 1]))
    ends = np.zeros(k, np.int64)
    present = np.flatnonzero(counts)
    for c in present:
        lo, hi = heads[c], large.at[c]
        if hi > lo:
            own = _chain(t, large.sa[lo:hi].copy(), c)
            large.sa[lo : lo + len(own)] = own
            hi = large.at[c] = lo + len(own)
        ends[c] = hi
        star = lms_by[cut[c] : cut[c + 1]]
        if hi == lo:
            src = star
        else:
            src = np.concatenate((large.sa[lo:hi], star)) if len(star) else large.sa[lo:hi]
        before = src[src > 0] - 1
        large.push(before[t[before] > c])
    small = _Buckets(t, k, -1)
    out = large.sa
    for c in present[::-1]:
        tail = heads[c] + counts[c]
        lo = small.at[c] + 1
        own = small.sa[lo:tail][::-1]
        if len(own):
            own = _chain(t, own.copy(), c)
            out[tail - len(own) : tail] = own[::-1]
        large_own = out[heads[c] : ends[c]][::-1]
        src = np.concatenate((own, large_own)) if len(own) else large_own
        before = src[src > 0] - 1
        small.push(before[t[before] < c])
    return out


def same(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
    """Whether the ``size`` symbols from each of ``a`` are those from ``b``, symbol by symbol."""
    out = np.ones(len(a), bool)
    todo = np.flatnonzero(size > 0)
    ends = np.cumsum(size[todo])
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, side="right")))
        which = todo[lo:hi]
        n = size[which]
        cut = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(cut, n)
        out[which] = np.logical_and.reduceat(t[np.repeat(a[which], n) + step] == t[np.repeat(b[which], n) + step], cut)
        lo = hi
    return out


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of ``t`` with symbols below ``k``.

    The leftmost-smaller substrings are sorted by one induction and named; where
    names repeat, the string of names is sorted the same way: as it is if names are
    few, else each name as two symbols of about the square root of their number,
    so that there are few buckets for the length of the string.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induce(t, k, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = induce(t, k, lms)
    ranked = sa[is_lms[sa]]
    end = np.zeros(n, np.int64)
    end[lms] = np.append(lms[1:] + 1, n)
    # Substrings are compared symbol by symbol; together they are hardly longer than the string.
    size = end[ranked] - ranked
    fresh = np.ones(len(ranked), np.int64)
    alike = np.flatnonzero(size[1:] == size[:-1])
    fresh[alike + 1] = ~same(t, ranked[alike], ranked[alike + 1], size[alike])
    names = np.cumsum(fresh) - 1
    distinct = int(names[-1]) + 1
    del size, alike, sa
    if distinct < len(lms):
        name_at = np.zeros(n, np.int64)
        name_at[ranked] = names
        reduced = name_at[lms]
        if distinct <= max(256, len(lms) // 80):
            order = suffix_array(reduced.astype(np.uint16) if distinct < 65536 else reduced, distinct)
        else:
            base = int(np.ceil(np.sqrt(distinct)))
            pairs = np.empty(2 * len(reduced), np.int64)
            pairs[0::2], pairs[1::2] = reduced // base, reduced % base
            order = suffix_array(pairs.astype(np.uint16 if base < 65536 else np.int64), base + 1)
            order = order[order % 2 == 0] // 2
        ranked = lms[order]
    return induce(t, k, ranked)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, usual: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix its predecessor in the array (-1: none) and the length of their common prefix.

    Where the symbols before both agree, the length is one less than that of the
    suffix one to the left; only the others are computed, by halving on hashes:
    lengths around ``usual`` first, the few beyond from the whole string on. Equal
    strings have equal hashes, so a length is never too small; those of ``usual``
    or more are held against the symbols, and cut where these differ. So a length is
    ``usual`` or more if and only if the prefixes are, and then it is exact.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    keep = np.ones(n, bool)
    inner = (at > 0) & (phi > 0)
    keep[inner] = t[at[inner] - 1] != t[phi[inner] - 1]
    base = at[keep]
    other = phi[base]
    rolling = Rolling(t, _POW)
    most = np.where(other < 0, 0, np.minimum(n - np.maximum(base, other), n))
    low = np.zeros(len(base), np.int64)

    def halve(which: np.ndarray, step: int) -> None:
        while step:
            ok = which[low[which] + step <= most[which]]
            i, j, p = base[ok], other[ok], low[ok] + step
            equal = rolling.raw(i, i + p) == rolling.raw(j, j + p)
            low[ok[equal]] = p[equal]
            step //= 2

    near = 1 << (2 * usual).bit_length()
    halve(np.arange(len(base)), near)
    far = np.flatnonzero(low == 2 * near - 1)
    if len(far):
        halve(far, 1 << n.bit_length())
    long = np.flatnonzero(low >= usual)
    for k in long[~same(t, base[long], other[long], low[long])]:
        i, j, n_ = int(base[k]), int(other[k]), int(low[k])
        low[k] = int((t[i : i + n_] != t[j : j + n_]).argmax())
    last = np.maximum.accumulate(np.where(keep, np.cumsum(keep) - 1, -1))
    return phi, low[last] - (at - base[last])
