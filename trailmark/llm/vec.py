"""Vectorised text primitives over Arrow batches.

A slice of documents is one flat ``uint8`` array plus offsets; words, rolling
hashes and sliding minima are computed for all documents of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ctypes

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def inverse(base: np.uint64) -> np.uint64:
    """Inverse of an odd number modulo 2**64 by Newton's iteration."""
    x, b = int(base), int(base)
    for _ in range(6):
        x = x * (2 - b * x) % 2**64
    return np.uint64(x)


class Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


M31 = np.uint64(2**31 - 1)
_TILE = 4096


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainders by the prime 2**31 - 1."""
    x = (x & M31) + (x >> np.uint64(31))
    x = (x & M31) + (x >> np.uint64(31))
    x -= M31 * (x >= M31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    p, m = np.ones(n, np.uint64), 1
    while m < n:
        p[m : 2 * m] = _mod(p[: min(m, n - m)] * np.uint64(pow(base, m, int(M31))))
        m *= 2
    return p


class Field:
    """Polynomial hashes over the field of 2**31 - 1 elements, in four bases drawn from ``seed``.

    Two bases give a hash of 62 bits (``FIRST``), the others a second one that is
    independent of it from the bytes on (``SECOND``). Equal strings hash alike
    whatever surrounds them; strings made to cancel modulo a power of two are
    nothing special here.
    """

    FIRST, SECOND = (0, 1), (2, 3)

    def __init__(self, seed: int = 20240607):
        draw = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.bases = [int(x) % (2**31 - 2**20) + 2**19 for x in draw]
        self._tables: dict[tuple, np.ndarray] = {}

    def _table(self, i: int, n: int, inverse_: bool = False, step: int = 1) -> np.ndarray:
        """Powers of base ``i`` (or its inverse) to ``step``."""
        key = (i, inverse_, step)
        if len(self._tables.get(key, ())) < n:
            b = pow(self.bases[i], -step if inverse_ else step, int(M31))
            self._tables[key] = _powers(b, max(n, 2 * len(self._tables.get(key, ()))))
        return self._tables[key][:n]

    def _spans(self, i: int, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Remainders of strings ``values[start:end]``, from sums over tiles so that no table grows with the text."""
        n = len(values)
        tiles = n // _TILE + 1
        v = np.zeros(tiles * _TILE, np.uint64)
        v[1 : n + 1] = values[: tiles * _TILE - 1]
        v[1 : n + 1] += np.uint64(1)
        local = np.cumsum(v.reshape(tiles, _TILE) * self._table(i, _TILE), axis=1).reshape(-1)
        far = self._table(i, tiles, step=_TILE)
        total = _mod(_mod(local[_TILE - 1 :: _TILE]) * far)
        before = _mod(np.cumsum(total) - total)

        def prefix(at: np.ndarray) -> np.ndarray:
            t = at // _TILE
            return _mod(before[t] + _mod(_mod(local[at]) * far[t]))

        d = prefix(end) + M31 - prefix(start)
        at = start + 1
        back = _mod(self._table(i, _TILE, True)[at % _TILE] * self._table(i, tiles + 1, True, _TILE)[at // _TILE])
        return _mod(_mod(d) * back)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, which: tuple[int, int] = FIRST) -> list[np.ndarray]:
        """Of bytes from ``start`` to ``end`` a remainder in each of the bases ``which``."""
        return [self._spans(i, values, start, end) for i in which]

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: tuple[int, ...] = FIRST, block: int = 1 << 13) -> list[np.ndarray]:
        """``spans`` for strings that follow one another; the usual short ones are summed directly, ``block`` at a time so that they stay in the cache."""
        n = end - start
        out = [np.zeros(len(n), np.uint64) for _ in which]
        if not len(n):
            return out
        longest = int(n.max())
        if longest >= _TILE:
            return self.spans(buf, start, end, which)
        tables = [self._table(i, longest) for i in which]
        for a in range(0, len(n), block):
            m, s = n[a : a + block], start[a : a + block]
            before = np.cumsum(m) - m
            at = np.arange(int(m.sum()))
            place = at - np.repeat(before, m)
            value = buf[at + np.repeat(s - before, m)].astype(np.uint64) + np.uint64(1)
            full = np.flatnonzero(m)
            if not len(full):
                continue
            for r, t in zip(out, tables, strict=True):
                r[a + full] = _mod(np.add.reduceat(value * t[place], before[full]))
        return out

    def grams(self, remainders: list[np.ndarray], k: int, which: tuple[int, ...] = FIRST, block: int = 1 << 14) -> list[np.ndarray]:
        """Of every run of k items their remainders as one, in pieces of ``block`` items."""
        out = []
        for i, r in zip(which, remainders, strict=True):
            n = max(len(r) - k + 1, 0)
            got = np.empty(n, np.uint64)
            for a in range(0, n, block):
                part = r[a : a + block + k - 1]
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_mod((part + np.uint64(1)) * self._table(i, len(part))), out=total[1:])
                m = len(part) - k + 1
                got[a : a + m] = _mod(_mod(total[k:] - total[:m]) * self._table(i, m, True))
            out.append(got)
        return out

    def at(self, remainders: list[np.ndarray], start: np.ndarray, k: int, which: tuple[int, ...] = FIRST) -> list[np.ndarray]:
        """``grams`` at the places ``start`` only."""
        out = []
        for i, r in zip(which, remainders, strict=True):
            got = np.zeros(len(start), np.uint64)
            for j in range(k - 1, -1, -1):
                got = _mod(got * np.uint64(self.bases[i]) + r[start + j] + np.uint64(1))
            out.append(got)
        return out

    @staticmethod
    def join(pair: list[np.ndarray]) -> np.ndarray:
        """Two remainders as one hash of 64 bits (62 of them free)."""
        return mix((pair[0] << np.uint64(31)) | pair[1])


FIELD = Field()


class Rolling:
    """Polynomial hashes of any substring of ``values`` in constant time, modulo 2**64: to order or file by, not to tell strings apart."""

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        up, self.down = powers.to(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        v = values.astype(np.uint64)
        v += np.uint64(1)
        v *= up[:n]
        np.cumsum(v, out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of k values."""
        n = len(self.prefix) - 1 - k + 1
        return mix((self.prefix[k:] - self.prefix[: len(self.prefix) - k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def pieces(offs: np.ndarray, overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes, and longer texts cut in runs that share ``overlap`` bytes: text, first byte, byte past the end of each part."""
    i, n = 0, len(offs) - 1
    while i < n:
        size = int(offs[i + 1] - offs[i])
        if size > limit + overlap:
            for a in range(0, size - overlap, limit):
                yield np.array([i]), offs[i : i + 1] + a, np.array([offs[i] + min(a + limit + overlap, size)])
            i += 1
            continue
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield np.arange(i, j), offs[i:j], offs[i + 1 : j + 1]
        i = j


def spans(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the intervals cover, touching ones as one."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], (start + length)[order]
    if not len(s):
        return s, e
    reach = np.maximum.accumulate(e)
    head = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
    return s[head], reach[np.append(head[1:], len(s)) - 1]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches at whole documents so that a slice holds about ``limit`` bytes; a longer document is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = flat(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def separators(buf: np.ndarray) -> np.ndarray:
    return (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of other bytes than 0x20 and 0x09-0x0D, and the first word of each document (with a last entry)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    sep = separators(buf)
    brk = np.zeros(n + 1, bool)
    brk[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = sep[:-1]
    starts = np.flatnonzero(~sep & (before | brk[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = sep[1:]
    ends = np.flatnonzero(~sep & (after | brk[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of runs of k items inside one document, and their document; ``first`` as from ``words``."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    base = np.concatenate(([0], np.cumsum(count)))[:-1]
    return np.arange(len(doc)) - np.repeat(base, count) + np.repeat(first[:-1], count), doc


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the least of the high 38 bits in every window of w values."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 26) - 1)
    if n > int(low):
        raise ValueError("slice too long")
    m = -(-n // w) * w
    v = np.full(m, np.uint64(2**64 - 1))
    v[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    blocks = v.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & low).astype(np.int64)


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of maximal runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))


def stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal values."""
    edge = runs(values)
    return edge, np.append(edge[1:], len(values))[: len(edge)]


def marked(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Boolean cover of [start, start+length) intervals over n places."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:n]) > 0


def release() -> None:
    """Give freed memory back to the system: a worker that waits between tasks would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about ``limit`` rows of batches sorted by ``key``, a whole number of groups each."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        t = pa.Table.from_batches(held)
        values = t.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield t.slice(0, cut).combine_chunks()
            held, rows = t.slice(cut).to_batches(), len(values) - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()
    release()
