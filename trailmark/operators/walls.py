"""Candidate points of a floor from its outline: along the walls, between opposite walls, fused and filtered."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .stateful import average_linkage, near_components


def along_ring(ring: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of a closed ring about ``spacing`` apart, its corners among them, and the inward normal at each."""
    nxt = np.roll(ring, -1, axis=0)
    area = float((ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum())
    pts, normals = [], []
    for a, b in zip(ring, nxt, strict=True):
        d = b - a
        length = float(np.hypot(*d))
        if length == 0:
            continue
        n = max(1, round(length / spacing))
        t = np.arange(n) / n
        pts.append(a + t[:, None] * d)
        left = np.array([-d[1], d[0]]) / length * (1 if area > 0 else -1)
        normals.append(np.repeat(left[None], n, axis=0))
    return (np.concatenate(pts), np.concatenate(normals)) if pts else (np.zeros((0, 2)), np.zeros((0, 2)))


def ray_length(origin: np.ndarray, direction: np.ndarray, ring: np.ndarray, limit: float) -> float:
    """Distance along a ray to the first wall beyond its own, at most ``limit``."""
    a, e = ring, np.roll(ring, -1, axis=0) - ring
    den = direction[0] * e[:, 1] - direction[1] * e[:, 0]
    r = a - origin
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (r[:, 0] * e[:, 1] - r[:, 1] * e[:, 0]) / den
        u = (r[:, 0] * direction[1] - r[:, 1] * direction[0]) / den
    hit = t[(den != 0) & (u >= 0) & (u <= 1) & (t > 1e-6)]
    return min(limit, float(hit.min())) if len(hit) else limit


def inside(pts: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points are inside a ring, by rays crossed."""
    out = np.zeros(len(pts), bool)
    for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if a[1] != b[1]:
            spans = (a[1] > pts[:, 1]) != (b[1] > pts[:, 1])
            out ^= spans & (pts[:, 0] < (b[0] - a[0]) * (pts[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
    return out


def between_walls(ring: np.ndarray, spacing: float, inner_gap: float, off_wall: float, limit: float) -> np.ndarray:
    """Points evenly spaced from each wall point to the wall opposite, ``off_wall`` away from both."""
    pts, normals = along_ring(ring, spacing)
    found = [np.zeros((0, 2))]
    for p, n in zip(pts, normals, strict=True):
        reach = ray_length(p, n, ring, limit)
        room = reach - 2 * off_wall
        if room <= 0:
            found.append((p + n * reach / 2)[None])
            continue
        k = max(1, int(room // inner_gap) + 1)
        at = off_wall + (np.arange(k) * room / (k - 1) if k > 1 else np.array([room / 2]))
        found.append(p + at[:, None] * n)
    got = np.concatenate(found)
    return got[inside(got, ring)]


def thin(pts: np.ndarray, least: float) -> np.ndarray:
    """Points in order, without those nearer than ``least`` to one kept before; cells of that size find neighbours."""
    kept: dict[tuple[int, int], list[np.ndarray]] = {}
    out = []
    for p in pts:
        c = (int(np.floor(p[0] / least)), int(np.floor(p[1] / least)))
        near = (q for i in (-1, 0, 1) for j in (-1, 0, 1) for q in kept.get((c[0] + i, c[1] + j), ()))
        if all(np.hypot(*(p - q)) >= least for q in near):
            kept.setdefault(c, []).append(p)
            out.append(p)
    return np.array(out).reshape(-1, 2)


def generate(outlines: DataFrame, known: DataFrame, by: list[str], spacing: float = 5.0, inner_gap: float = 6.0, off_wall: float = 2.0, limit: float = 40.0, least: float = 3.0, band: tuple[float, float] = (2.0, 60.0)) -> DataFrame:
    """Candidates of each floor: inner points of its outline (i, x, y) whose distance to the nearest known point (x, y) is within ``band``.

    A floor without known points keeps all; one without an outline has none.
    """

    def one(shape: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "id", "x", "y"]
        if not len(shape):
            return pd.DataFrame(columns=cols)
        ring = shape.sort_values("i")[["x", "y"]].to_numpy(float)
        got = thin(between_walls(ring, spacing, inner_gap, off_wall, limit), least)
        if len(points) and len(got):
            p = points[["x", "y"]].to_numpy(float)
            d = np.array([np.hypot(*(p - g).T).min() for g in got])
            got = got[(d >= band[0]) & (d <= band[1])]
        out = pd.DataFrame({"id": np.arange(len(got)), "x": got[:, 0], "y": got[:, 1]})
        for c in by:
            out[c] = shape[c].iloc[0]
        return out[cols]

    kinds = dict(outlines.dtypes)
    return outlines.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", id long, x double, y double")


def ring_places(pts: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Distance of points from a closed ring, their places along it, and its length."""
    edge = np.roll(ring, -1, axis=0) - ring
    size = np.hypot(*edge.T)
    before = np.cumsum(size) - size
    to = pts[:, None] - ring[None]
    t = np.clip((to * edge[None]).sum(-1) / np.maximum(size**2, 1e-12), 0, 1)
    away = np.hypot(*(to - t[..., None] * edge[None]).transpose(2, 0, 1))
    best = away.argmin(axis=1) if len(pts) else np.zeros(0, int)
    row = np.arange(len(pts))
    return away[row, best], before[best] + t[row, best] * size[best], float(size.sum())


def local_medians(value: np.ndarray, along: np.ndarray, around: float, at: np.ndarray, half: int = 4, reach: float = 40.0) -> np.ndarray:
    """Median of the values at up to ``half`` places either side of each place ``at`` on a ring, none further than ``reach``; that of all where none is near."""
    if not len(value):
        return np.full(len(at), np.nan)
    order = np.argsort(along, kind="stable")
    v, a = value[order], along[order]
    n, out = len(v), np.empty(len(at))
    for i, p in enumerate(at):
        k = int(np.searchsorted(a, p))
        idx = np.unique(np.arange(k - half, k + half) % n)
        gap = np.abs(a[idx] - p)
        near = idx[np.minimum(gap, around - gap) <= reach]
        out[i] = np.median(v[near] if len(near) else v)
    return out


def fused(pts: np.ndarray, threshold: float) -> np.ndarray:
    """Centroids of average-linkage clusters."""
    if not len(pts):
        return pts
    label = near_components(pts, threshold)
    return np.array([pts[np.flatnonzero(label == c)[m]].mean(0) for c in range(label.max() + 1) for m in average_linkage(pts[label == c], threshold)])


def wall_habits(known: np.ndarray, ring: np.ndarray, maybe: float = 2.0, sure: float = 0.4) -> dict:
    """How a floor's known points stand to its walls: which are wall points, their distance and place, the usual gap along the wall and between any two."""
    away, along, around = ring_places(known, ring)
    near = away < maybe
    limit = max(1.5 * float(np.quantile(away[near], 0.7)), sure) if near.any() else 0.0
    wall = away < limit
    places = np.sort(along[wall])
    gaps = np.diff(np.append(places, places[:1] + around)) if wall.sum() > 1 else np.zeros(0)
    d = np.hypot(*(known[:, None] - known[None]).transpose(2, 0, 1)) + np.diag(np.full(len(known), np.inf)) if len(known) > 1 else np.zeros((0, 0))
    nearest = d.min(axis=1) if len(d) else np.zeros(0)
    nearest = nearest[(nearest > 1.2) & (nearest < 20)]
    return {"away": away[wall], "along": along[wall], "around": around, "gap": float(np.median(gaps)) if len(gaps) else np.nan, "usual": float(np.median(nearest)) if len(nearest) else np.nan}


def generate_from_known(outlines: DataFrame, known: DataFrame, by: list[str], spacing: float = 5.0, inner: float = 6.0, off_wall: float = 1.0, wall_share: float = 0.4, inner_share: float = 0.7, least: float = 3.0, most: float = 30.0, fuse: float = 0.8, limit: float = 40.0) -> DataFrame:
    """Candidates of each floor as its known points would lead to expect: id, x, y, kind (wall or inner).

    ``outlines`` has the ring (i, x, y), ``known`` points (x, y). Known points
    nearer than ``fuse`` are one. Their usual gaps along the walls and between
    each other, times ``wall_share`` and ``inner_share``, set the spacing; the local
    median of their distances from the wall sets how far off it candidates stand.
    Where known points tell nothing ``spacing``, ``inner`` and ``off_wall`` do.
    From each wall candidate inner ones follow to the wall opposite. Kept are
    points inside, apart, and from ``least`` to ``most`` from the nearest known one
    (all, without known ones). A floor without an outline has none; a group is
    one floor.
    """

    def one(shape: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "id", "x", "y", "kind"]
        if not len(shape):
            return pd.DataFrame(columns=cols)
        ring = shape.sort_values("i")[["x", "y"]].to_numpy(float)
        own = fused(np.unique(points[["x", "y"]].to_numpy(float), axis=0), fuse) if len(points) else np.zeros((0, 2))
        habit = wall_habits(own, ring) if len(own) else {"away": np.zeros(0), "along": np.zeros(0), "around": 1.0, "gap": np.nan, "usual": np.nan}
        step = spacing if np.isnan(habit["gap"]) else max(wall_share * habit["gap"], 0.5)
        room = inner if np.isnan(habit["usual"]) else max(inner_share * habit["usual"], 0.5)
        pts, normals = along_ring(ring, step)
        off = local_medians(habit["away"], habit["along"], habit["around"], ring_places(pts, ring)[1])
        off = np.where(np.isnan(off), off_wall, np.maximum(off, 0.05))
        found, kinds = [np.zeros((0, 2))], []
        for p, n, o in zip(pts, normals, off, strict=True):
            reach = ray_length(p, n, ring, limit)
            at = np.array([reach / 2]) if reach <= 2 * o else np.append(np.arange(o, reach - o, room), [])
            found.append(p + at[:, None] * n)
            kinds += ["wall"] + ["inner"] * (len(at) - 1)
        got, kind = np.concatenate(found), np.array(kinds, object)
        # Wall candidates are kept before inner ones that come too near.
        order = np.argsort(kind != "wall", kind="stable")
        got, kind = got[order], kind[order]
        ok = inside(got, ring)
        got, kind = got[ok], kind[ok]
        kept = thin(got, min(step, room) / 2)
        where = {tuple(p): k for p, k in zip(got[::-1].tolist(), kind[::-1], strict=True)}
        kind = np.array([where[tuple(p)] for p in kept.tolist()], object)
        if len(own) and len(kept):
            d = np.array([np.hypot(*(own - g).T).min() for g in kept])
            kept, kind = kept[(d >= least) & (d <= most)], kind[(d >= least) & (d <= most)]
        out = pd.DataFrame({"id": np.arange(len(kept)), "x": kept[:, 0], "y": kept[:, 1], "kind": kind})
        for c in by:
            out[c] = shape[c].iloc[0]
        return out[cols]

    kinds_ = dict(outlines.dtypes)
    return outlines.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(one, ", ".join(f"{c} {kinds_[c]}" for c in by) + ", id long, x double, y double, kind string")


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring without vertices nearer than ``tolerance`` to the line that is left, the farthest kept first."""
    if len(ring) < 4:
        return ring
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    keep, stack, loop = {0, far, len(ring)}, [(0, far), (far, len(ring))], np.vstack((ring, ring[:1]))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, e = loop[a + 1 : b] - loop[a], loop[b] - loop[a]
        size = float(np.hypot(*e))
        away = np.abs(p[:, 0] * e[1] - p[:, 1] * e[0]) / size if size else np.hypot(*p.T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return loop[sorted(keep - {len(ring)})]


def floor_rings(outlines: DataFrame, sizes: DataFrame, by: list[str], tolerance: float = 0.2) -> DataFrame:
    """Rings (part, ring, i, x, y) in metres: the box of a floor's outline (part 0) becomes its width and height, and rings are simplified.

    ``sizes`` has width and height; floors without are left out. A closing point
    equal to the first goes. A group is one floor.
    """

    def one(shape: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "part", "ring", "i", "x", "y"]
        outer = shape[shape["part"] == 0]
        if not len(size) or not len(outer):
            return pd.DataFrame(columns=cols)
        low, high = outer[["x", "y"]].min().to_numpy(float), outer[["x", "y"]].max().to_numpy(float)
        scale = size[["width", "height"]].to_numpy(float)[0] / np.where(high > low, high - low, 1)
        rows = []
        for (part, ring), g in shape.groupby(["part", "ring"]):
            xy = (g.sort_values("i")[["x", "y"]].to_numpy(float) - low) * scale
            if len(xy) > 1 and (xy[0] == xy[-1]).all():
                xy = xy[:-1]
            rows += [(part, ring, i, *p) for i, p in enumerate(simplified(xy, tolerance).tolist())]
        out = pd.DataFrame(rows, columns=cols[len(by) :])
        for c in by:
            out[c] = shape[c].iloc[0]
        return out[cols]

    kinds = dict(outlines.dtypes)
    return outlines.groupBy(*by).cogroup(sizes.groupBy(*by)).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", part int, ring int, i int, x double, y double")
