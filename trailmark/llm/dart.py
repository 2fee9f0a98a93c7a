"""DartMinHash: sparse weighted minwise signatures.

Every element owns a plane of weight and rank on which darts fall at unit rate
for each of ``t`` coordinates. Darts are fixed by hashing the element and the
region of the plane, so they agree between sets. A set sees the darts of its
elements below their weights; per coordinate the dart of least rank is its
signature. Ranks are opened band by band until each coordinate has a dart, so a
set of many elements throws few darts at each.
"""

from __future__ import annotations

import numpy as np

from .vec import mix

FIRST = 2.0**-11
_G = np.uint64(0x9E3779B97F4A7C15)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Counts with the given mean by inversion of uniform numbers."""
    out = np.zeros(len(u), np.int64)
    p = total = np.exp(-mean)
    k = 0
    left = np.flatnonzero(u >= total)
    while len(left):
        k += 1
        out[left] = k
        p *= mean / k
        total += p
        left = left[u[left] >= total] if p > 1e-17 else left[:0]
    return out


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, t: int, seed: int = 1) -> np.ndarray:
    """An n x t array of 64-bit dart hashes; a row of a set without elements of positive weight is zero.

    ``element`` holds 64-bit hashes, ``weight`` non-negative numbers and ``owner``
    the set (below n) of each; an element occurs once in a set.
    """
    sig = np.zeros(n * t, np.uint64)
    rank = np.full(n * t, np.inf)
    live = weight > 0
    element, weight, owner = element[live], weight[live], owner[live]
    # The plane is cut at weights 1, 2, 4, 8, ...; the last layer counts up to the weight only.
    layers = 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
    low, high, band = 0.0, FIRST, 0
    while len(element):
        for layer in range(int(layers.max())):
            floor_ = 0.0 if layer == 0 else 2.0 ** (layer - 1)
            tall = max(1.0, floor_)
            mean = t * (high - low) * tall
            here = np.flatnonzero(layers > layer)
            region = mix(element[here] ^ mix(np.array([seed * 1_000_003 + band * 4099 + layer], np.uint64)))
            # Pieces keep a dense band at few darts at a time.
            pieces = 1 << max(0, int(np.ceil(np.log2(mean / 16)))) if mean > 16 else 1
            for piece in range(pieces):
                seedling = region if pieces == 1 else mix(region + np.uint64((piece + 1) * int(_G) % 2**64))
                many = _poisson(_unit(seedling), mean / pieces)
                hit = np.flatnonzero(many)
                src = np.repeat(hit, many[hit])
                if not len(src):
                    continue
                nth = np.arange(len(src)) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit])
                dart = mix(seedling[src] + (nth + 1).astype(np.uint64) * _G)
                at = floor_ + tall * _unit(mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                ok = at < weight[here[src]]
                dart, src = dart[ok], src[ok]
                width = (high - low) / pieces
                r = low + width * (piece + _unit(mix(dart ^ np.uint64(0x5A5A5A5A5A5A5A5A))))
                slot = owner[here[src]] * t + (dart % np.uint64(t)).astype(np.int64)
                np.minimum.at(rank, slot, r)
                won = rank[slot] == r
                sig[slot[won]] = dart[won]
        open_ = np.isinf(rank.reshape(n, t)).any(axis=1)
        keep = open_[owner]
        element, weight, owner, layers = element[keep], weight[keep], owner[keep], layers[keep]
        low, high, band = high, high * 2, band + 1
    return sig.reshape(n, t)
