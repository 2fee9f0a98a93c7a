"""Path optimiser: signal penalties of grid candidates, and a beam search under all movement penalties."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import fingerprint as P

#: Weights, exponents and limits of the penalties.
NEAR_POSITIONS = 20
NEAR_KEPT = 10
NEAR_EXPONENT = 1.5
WEIGHTED_EXPONENT = 0.8
WEIGHTED_SHARE = 0.8
POSITION_POWER = 4
LEAST_OFFSET_S = 2.0
EDGE_CUTOFF_S = 15.0
EDGE_DECAY_S = 20.0
EDGE_NEARBY = 2.0
EDGE_EXACT = 5.0
EDGE_LIMIT = 0.7
EDGE_DISSIMILARITY = 15.0
EDGE_MOST = 30.0
DISTANCE_WEIGHT = 30.0
DISTANCE_SPREAD = 0.12
RELATIVE_ANGLE_WEIGHT = 9.0
ABSOLUTE_WEIGHT = 1.5
CUMULATIVE_WEIGHT = 1.0
MOVE_SPREAD = 0.2
MOST_CERTAIN = 4.0
DIRECTION_WEIGHT = 0.5
FORBIDDEN = 1e6
#: Candidates of a floor up to which the moves between every two are kept.
TABLE = 512

PENALTIES = ("signal", "distance", "relative", "absolute", "edge", "direction", "off_grid", "dense")


def edge_pull(distance: Column, delay_s: Column, dissimilarity: Column) -> Column:
    """Penalty of starting or ending ``distance`` away from where a neighbouring trajectory of the same device did."""
    reach = F.log2(delay_s + 1) * EDGE_LIMIT
    doubt = F.when(dissimilarity <= EDGE_DISSIMILARITY, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.pow((dissimilarity - EDGE_DISSIMILARITY) / EDGE_DISSIMILARITY, 1.5)))
    far = F.greatest(F.lit(0.0), EDGE_NEARBY * (distance / reach - 1))
    pull = doubt / (1 + delay_s / EDGE_DECAY_S) * (F.when(distance > 1e-3, EDGE_EXACT).otherwise(0.0) + far * far)
    return F.when((delay_s > 0) & (delay_s < EDGE_CUTOFF_S) & distance.isNotNull(), F.least(F.lit(EDGE_MOST), pull)).otherwise(0.0)


def nearest_positions(candidates: DataFrame, positions: DataFrame, by: list[str], k: int = NEAR_POSITIONS) -> DataFrame:
    """``by, cand, pos``: the ``k`` known positions (pos, px, py) nearest each candidate, ties by position; a floor's grid and positions are bounded by its size."""
    d = X.euclid(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    w = Window.partitionBy(*by, "cand").orderBy("d", "pos")
    return candidates.join(positions, by).withColumn("d", d).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(*by, "cand", "pos")


def signal_penalties(distances: DataFrame, candidates: DataFrame, anchors: DataFrame, by: list[str], trail: list[str]) -> DataFrame:
    """Of every anchor and candidate the signal penalty, and of the anchor the weighted position (wx, wy).

    ``distances``: by, trail, scan (ms), pos, px, py, distance. ``candidates``: by,
    cand, x, y. ``anchors``: by, trail, step, time. A scan's penalty of a
    candidate is the excess over the floor's best of 1.5 mean + 1.5 least of the
    smaller half of the distances at the nearest positions; or that of the way
    from the weighted position, if less. An anchor takes the scans before and
    after it, the nearer one with more weight; anchors of trails without scans
    give no rows.
    """
    key = [*by, *trail]
    positions = distances.select(*by, "pos", "px", "py").distinct()
    near = nearest_positions(candidates, positions, by)
    small = F.slice(F.sort_array(F.collect_list("distance")), 1, NEAR_KEPT)
    mean = F.aggregate(small, F.lit(0.0), lambda a, b: a + b) / F.size(small)
    at = distances.join(near, [*by, "pos"]).groupBy(*key, "scan", "cand").agg((1.5 * mean + 1.5 * small[0]).alias("v"))
    lowest = Window.partitionBy(*key, "scan")
    at = at.withColumn("near", F.col("v") - F.min("v").over(lowest)).drop("v")
    rank = Window.partitionBy(*key, "scan").orderBy("distance", "pos")
    top = distances.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= NEAR_POSITIONS).withColumn("lo", F.min("distance").over(lowest))
    weight = F.pow((F.col("distance") + 1e-5) / (F.col("lo") + 1e-5), -POSITION_POWER)
    spot = top.groupBy(*key, "scan").agg((F.sum(weight * F.col("px")) / F.sum(weight)).alias("wx"), (F.sum(weight * F.col("py")) / F.sum(weight)).alias("wy"))
    way = X.euclid(F.col("x") - F.col("wx"), F.col("y") - F.col("wy"))
    at = at.join(candidates, [*by, "cand"]).join(spot, [*key, "scan"]).withColumn("way", way)
    at = at.withColumn("far", F.col("way") - F.min("way").over(lowest)).select(*key, "scan", "cand", "near", "far", "wx", "wy")
    return _at_anchors(at, distances.select(*key, "scan"), anchors, key)


def _at_anchors(at: DataFrame, scans: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """Signal penalties of anchors from those of the scans (key, scan) before and after them."""
    scans = scans.groupBy(*key).agg(F.sort_array(F.collect_set("scan")).alias("scans"))
    before = F.size(F.filter("scans", lambda s: s < F.col("time")))
    ends = anchors.join(scans, key).withColumn("n", before)
    low, high = F.element_at("scans", F.greatest(F.lit(1), F.col("n"))), F.element_at("scans", F.least(F.size("scans"), F.col("n") + 1))
    off = lambda s: 1 / F.greatest(F.lit(LEAST_OFFSET_S), F.abs(s - F.col("time")) / 1000)
    both = ends.select(*key, "step", F.explode(F.array(*[F.struct(s.alias("scan"), off(s).alias("w")) for s in (low, high)])).alias("s")).select(*key, "step", "s.scan", "s.w")
    joined = both.join(at, [*key, "scan"]).groupBy(*key, "step", "cand").agg((F.sum(F.col("w") * F.col("near")) / F.sum("w")).alias("near"), F.avg("far").alias("far"), F.sum("w").alias("w"), F.avg("wx").alias("wx"), F.avg("wy").alias("wy"))
    penalty = F.col("w") * F.least(F.pow("near", NEAR_EXPONENT), WEIGHTED_SHARE * F.pow("far", WEIGHTED_EXPONENT))
    return joined.select(*key, "step", "cand", penalty.alias("signal"), "wx", "wy")


def signal_penalties_of_scans(readings: DataFrame, model: DataFrame, positions: DataFrame, candidates: DataFrame, anchors: DataFrame, by: list[str], trail: list[str]) -> DataFrame:
    """``signal_penalties`` with ``fingerprint.distances`` of ``readings`` (by, trail, scan, emitter, rssi, delay) and ``model``, without a row for a scan and position.

    ``positions``: by, pos, px, py of those of the model. The floor's candidates go
    with its first position.
    """
    key = [*by, *trail]
    grid = candidates.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cand", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("grid"))
    first = Window.partitionBy(*by).orderBy("pos")
    own = positions.select(*by, "pos", "px", "py").join(grid, by, "left").withColumn("grid", F.when(F.row_number().over(first) == 1, F.col("grid")))

    def pick(key: dict, d: np.ndarray, shared: np.ndarray, at: P.Site) -> tuple | None:
        px, py = at.extra["px"], at.extra["py"]
        if not at.cache:
            grid = at.extra["grid"][0]
            if grid is None:
                at.cache["cand"] = None
            else:
                x, y = (np.array([g[c] for g in grid], float) for c in ("x", "y"))
                near = np.stack([P.nearest(np.sqrt((a - px) ** 2 + (b - py) ** 2), NEAR_POSITIONS) for a, b in zip(x, y, strict=True)])
                at.cache |= {"cand": np.array([g["cand"] for g in grid]), "x": x, "y": y, "near": near}
        if at.cache["cand"] is None:
            return None
        small = np.sort(d[at.cache["near"]], axis=1)[:, :NEAR_KEPT]
        value = 1.5 * small.mean(1) + 1.5 * small[:, 0]
        top = P.nearest(d, NEAR_POSITIONS)
        weight = ((d[top] + 1e-5) / (d[top[0]] + 1e-5)) ** -POSITION_POWER
        wx, wy = (weight * px[top]).sum() / weight.sum(), (weight * py[top]).sum() / weight.sum()
        way = np.sqrt((at.cache["x"] - wx) ** 2 + (at.cache["y"] - wy) ** 2)
        return at.cache["cand"], value - value.min(), way - way.min(), np.full(len(way), wx), np.full(len(way), wy)

    fields = f"cand {dict(candidates.dtypes)['cand']}, near double, far double, wx double, wy double"
    at = P.per_scan(readings, model, by, [*trail, "scan"], P.weighted(), pick, fields, own)
    scans = readings.select(*key, "scan").distinct().join(positions.select(*by).distinct(), by, "left_semi")
    return _at_anchors(at, scans, anchors, key)


def _wrap(angle: np.ndarray) -> np.ndarray:
    """Size of an angle, at most pi."""
    return np.abs((angle + np.pi) % (2 * np.pi) - np.pi)


def _edge(distance: np.ndarray, delay_s: float, dissimilarity: float) -> np.ndarray:
    """``edge_pull`` for arrays."""
    if not 0 < delay_s < EDGE_CUTOFF_S or np.isnan(distance).any():
        return np.zeros_like(distance)
    doubt = 1.0 if dissimilarity <= EDGE_DISSIMILARITY else max(0.0, 1 - ((dissimilarity - EDGE_DISSIMILARITY) / EDGE_DISSIMILARITY) ** 1.5)
    far = np.maximum(0, EDGE_NEARBY * (distance / (math.log2(delay_s + 1) * EDGE_LIMIT) - 1))
    return np.minimum(EDGE_MOST, doubt / (1 + delay_s / EDGE_DECAY_S) * ((distance > 1e-3) * EDGE_EXACT + far**2))


class Moves:
    """Differences, lengths and directions of moves between candidates at ``pos``; of a grid of at most ``table`` ones they are worked out once."""

    def __init__(self, pos: np.ndarray, table: int = TABLE):
        self.pos = pos
        self.whole = self._from(np.arange(len(pos))) if len(pos) <= table else None

    def _from(self, last: np.ndarray) -> tuple[np.ndarray, ...]:
        dx, dy = (self.pos[None] - self.pos[last][:, None]).transpose(2, 0, 1)
        return dx, dy, np.hypot(dx, dy), np.arctan2(dy, dx)

    def to_all(self, last: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(m[last] for m in self.whole) if self.whole else self._from(last)

    def to(self, last: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, ...]:
        if self.whole:
            return tuple(m[last, nxt] for m in self.whole)
        dx, dy = (self.pos[nxt] - self.pos[last]).T
        return dx, dy, np.hypot(dx, dy), np.arctan2(dy, dx)


def misfit(step: dict, dx: np.ndarray, dy: np.ndarray, size: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """How far moves are from the one wanted; infinite beyond 45 degrees."""
    error = np.abs(dx - step["ax"]) + np.abs(dy - step["ay"]) + 4 * np.abs(size - step["distance"])
    error[_wrap(angle - math.atan2(step["ay"], step["ax"])) > np.pi / 4] = np.inf
    return error


def walk_of(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A trail's steps as arrays of numbers: nulls are NaN, of ``reliable`` false."""
    return {c: np.array([x is True or x is np.True_ for x in v]) if c.endswith("_reliable") else np.asarray(v, float) for c, v in columns.items()}


class Beam:
    """The cheapest beginnings of a trail's path: candidates of each step and total; penalties of a step with the row of the step before that a beginning goes on from."""

    def __init__(self, walk: dict[str, np.ndarray], cand: np.ndarray, moves: Moves, fixed: dict[str, np.ndarray], signal: np.ndarray, width: int, by_signal: int, by_move: int):
        """``walk`` has the columns ``STEP`` in order; ``signal`` is by step and candidate; ``fixed`` are penalties of being at a candidate."""
        self.n = len(walk["ax"])
        self.steps = [dict(zip(walk, v, strict=True)) for v in zip(*(v.tolist() for v in walk.values()), strict=True)]
        self.cand, self.moves, self.pos, self.fixed, self.signal = cand, moves, moves.pos, fixed, signal
        self.wanted, self.root, self.axes = np.stack((walk["ax"], walk["ay"]), 1), np.sqrt(np.arange(self.n, 0, -1)), np.ascontiguousarray(self.pos.T)
        self.width, self.by_signal, self.by_move = width, min(by_signal, len(self.cand)), by_move
        self.best_by_signal = np.argsort(signal, axis=1, kind="stable")[:, : self.by_signal]

    def first(self) -> None:
        keep = np.argsort(self.signal[0], kind="stable")[: self.width]
        keep = keep[np.argsort(self.signal[0][keep] + sum(v[keep] for v in self.fixed.values()), kind="stable")]
        part = {p: np.zeros(len(keep)) for p in PENALTIES} | {"signal": self.signal[0][keep]} | {c: v[keep] for c, v in self.fixed.items()}
        self.path, self.parts, self.back, self.total = keep[:, None], [part], [np.arange(len(keep))], sum(part.values())

    def search(self) -> None:
        self.first()
        for i in range(1, self.n):
            self.advance(i)

    def fits(self, i: int, last: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``last`` up to ``by_move`` candidates, none of ``best``, that best fit the wanted movement within 45 degrees, and which of them there are."""
        error = misfit(self.steps[i], *self.moves.to_all(last))
        error[:, best] = np.inf
        fit = np.argsort(error, axis=1, kind="stable")[:, : self.by_move]
        return fit, np.isfinite(np.take_along_axis(error, fit, 1))

    def expand(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings with their next candidates: the best by signal, and others by movement."""
        best = self.best_by_signal[i]
        # Many beginnings end at one candidate.
        number = np.full(len(self.cand), -1)
        number[self.path[:, -1]] = 0
        last = np.flatnonzero(number == 0)
        number[last] = np.arange(len(last))
        fit, ok = self.fits(i, last, best)
        k = len(best)
        nxt, there = np.empty((len(last), k + fit.shape[1]), np.int64), np.ones((len(last), k + fit.shape[1]), bool)
        nxt[:, :k], nxt[:, k:], there[:, k:] = best, fit, ok
        of = number[self.path[:, -1]]
        there = there[of]
        return np.nonzero(there)[0], nxt[of][there]

    def advance(self, i: int) -> None:
        s, before = self.steps[i], self.steps[i - 1]
        row, nxt = self.expand(i)
        prev = self.path[row, -1]
        dx, dy, size, angle = self.moves.to(prev, nxt)
        part = {p: None for p in PENALTIES} | {"signal": self.signal[i][nxt]}
        certain = min(MOST_CERTAIN, DISTANCE_SPREAD / s["spread"])
        part["distance"] = certain * DISTANCE_WEIGHT / 5 * np.abs(size - s["distance"]) / max(1e-6, 1.4 * (1 - 1 / (s["distance"] ** 0.5 + 0.5)))
        wx, wy = s["wx"] - before["wx"], s["wy"] - before["wy"]
        norm = math.hypot(wx, wy)
        part["direction"] = -DIRECTION_WEIGHT * math.sqrt(norm) * (dx * wx + dy * wy) / ((norm + 1e-9) * (size + 1e-9))
        back = FORBIDDEN * (_wrap(angle - math.atan2(s["ay"], s["ax"])) > np.pi / 2)
        certain = min(MOST_CERTAIN, MOVE_SPREAD / s["move_spread"])
        left = np.flip(np.cumsum(np.flip(self.wanted[1 : i + 1], 0), 0), 0)
        gone_x, gone_y = (v[nxt][:, None] - v[self.path][row] for v in self.axes)
        cumulative = ((np.abs(gone_x - left[:, 0]) + np.abs(gone_y - left[:, 1])) / self.root[-i:]).mean(1)
        part["absolute"] = certain * (ABSOLUTE_WEIGHT * (np.abs(dx - s["ax"]) + np.abs(dy - s["ay"])) + CUMULATIVE_WEIGHT * cumulative + back)
        if i > 1:
            turn = angle - self.moves.to(self.path[:, -2], self.path[:, -1])[3][row]
            part["relative"] = RELATIVE_ANGLE_WEIGHT * _wrap(math.atan2(s["ry"], s["rx"]) - turn)
        if i == 1 and s["before_reliable"]:
            away = np.hypot(*(self.pos[self.path[row, 0]] - [s["before_x"], s["before_y"]]).T)
            part["edge"] = _edge(away, s["before_delay_s"], s["before_dissimilarity"])
        if i == self.n - 1 and s["after_reliable"]:
            away = np.hypot(*(self.pos[nxt] - [s["after_x"], s["after_y"]]).T)
            end = _edge(away, s["after_delay_s"], s["after_dissimilarity"])
            part["edge"] = end if part["edge"] is None else part["edge"] + end
        for c, v in self.fixed.items():
            part[c] = v[nxt]
        total = self.total[row] + FORBIDDEN * (prev == nxt) + sum(v for v in part.values() if v is not None)
        keep = self.keep(i, row, nxt, total)
        self.path = np.concatenate((self.path[row[keep]], nxt[keep][:, None]), axis=1)
        self.parts.append({p: v if v is None else v[keep] for p, v in part.items()})
        self.back.append(row[keep])
        self.total = total[keep]

    def keep(self, i: int, row: np.ndarray, nxt: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.argsort(total, kind="stable")[: self.width]

    def trace(self, k: int) -> dict[str, list[float]]:
        """Penalties by step of the path in row ``k``."""
        out: dict[str, list[float]] = {p: [] for p in PENALTIES}
        for part, back in zip(reversed(self.parts), reversed(self.back), strict=True):
            for p, v in part.items():
                out[p].append(0.0 if v is None else float(v[k]))
            k = back[k]
        return {p: v[::-1] for p, v in out.items()}

    def best(self) -> dict[str, list]:
        """The cheapest path with each step's penalties, and how far the second is."""
        one, n = self.path[0], self.n
        second = self.path[1] if len(self.path) > 1 else one
        out = {"cand": self.cand[one].tolist(), "x": self.pos[one, 0].tolist(), "y": self.pos[one, 1].tolist(), **self.trace(0)}
        gap = float(self.total[1] - self.total[0]) if len(self.path) > 1 else None
        return out | {"total": [float(self.total[0])] * n, "gap_second": [gap] * n, "distance_second": [float(np.hypot(*(self.pos[one] - self.pos[second]).T).sum())] * n}


STEP = ("step", "distance", "ax", "ay", "rx", "ry", "spread", "move_spread", "wx", "wy", "before_reliable", "before_x", "before_y", "before_delay_s", "before_dissimilarity", "after_reliable", "after_x", "after_y", "after_delay_s", "after_dissimilarity")


def search_paths(steps: DataFrame, cells: DataFrame, trail: list[str], width: int = 200, by_signal: int = 10, by_move: int = 40) -> DataFrame:
    """The best path of every trail with the penalties of each step: step, cand, x, y, ``PENALTIES``, total, gap_second, distance_second.

    ``steps`` has a row for each anchor with the columns ``STEP``: the wanted
    movement to it (length, absolute and relative direction, uncertainties), the
    signal's position, and where neighbouring trajectories start and end.
    ``cells`` has each anchor's candidates: step, cand, x, y, signal, off_grid,
    dense. A group is one trail with its floor's grid, which do not grow with the
    number of trails. Trails without steps or candidates give no rows. Ties go to
    the beginning found first, candidates in their order.
    """

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*trail, "step", "cand", "x", "y", *PENALTIES, "total", "gap_second", "distance_second"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        # Every step has the same candidates, those of the floor.
        at = right.drop_duplicates("cand").sort_values("cand")
        left = left.sort_values("step")
        signal = right.pivot(index="step", columns="cand", values="signal").reindex(index=left["step"], columns=at["cand"]).to_numpy(float)
        walk = walk_of({c: left[c].to_numpy() for c in STEP[1:]})
        beam = Beam(walk, at["cand"].to_numpy(), Moves(at[["x", "y"]].to_numpy(float)), {c: at[c].to_numpy(float) for c in ("off_grid", "dense")}, signal, width, by_signal, by_move)
        beam.search()
        out = pd.DataFrame(beam.best()).assign(step=left["step"].to_numpy())
        for c in trail:
            out[c] = left[c].iloc[0]
        return out[names]

    names = [*trail, "step", "cand", "x", "y", "signal", "off_grid", "dense"]
    # Columns of their own, as both sides may come from one table.
    cells = cells.select(*names).toDF(*names)
    kinds = dict(steps.dtypes) | {"cand": dict(cells.dtypes)["cand"]}
    fields = [f"{c} {kinds[c]}" for c in (*trail, "step", "cand")] + [f"{c} double" for c in ("x", "y", *PENALTIES, "total", "gap_second", "distance_second")]
    return steps.select(*trail, *STEP).groupBy(*trail).cogroup(cells.groupBy(*trail)).applyInPandas(one, ", ".join(fields))


def search_floors(steps: DataFrame, grid: DataFrame, by: list[str], trail: list[str], signal: Callable[[dict, dict], np.ndarray], width: int = 200, by_signal: int = 10, by_move: int = 40, trails_per_task: int = 64) -> DataFrame:
    """``search_paths`` of trails whose candidates are those of their floor, without a row for a step and candidate.

    ``steps``: by, trail and the columns ``STEP``; ``grid``: by, cand, x, y, off_grid,
    dense. ``signal`` makes of a trail's steps and a floor's candidates, both columns
    of arrays, the signal penalties by step and candidate. Trails of floors without
    candidates give no rows.
    """
    key = [*by, *trail]
    walks = steps.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*STEP))).alias("steps"))
    floors = grid.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cand", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "off_grid", "dense")]))).alias("grid"))
    numbers = ("x", "y", *PENALTIES, "total", "gap_second", "distance_second")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in (*trail, "step", "cand", *numbers)}
        own = {c: left.schema.field(c).type for c in trail} | {"step": left.schema.field("steps").type.value_type.field("step").type, "cand": right.schema.field("grid").type.value_type.field("cand").type}
        if left.num_rows and right.num_rows:
            _, cand = lists(right, "grid")
            moves, fixed = Moves(np.stack((cand["x"], cand["y"]), 1)), {c: cand[c] for c in ("off_grid", "dense")}
            ends, every = lists(left, "steps")
            keys = {c: left[c].to_pylist() for c in trail}
            for k in range(left.num_rows):
                given = {c: v[ends[k] : ends[k + 1]] for c, v in every.items()}
                walk = walk_of({c: given[c] for c in STEP[1:]})
                beam = Beam(walk, cand["cand"], moves, fixed, signal(walk, cand), width, by_signal, by_move)
                beam.search()
                for c, v in (beam.best() | {"step": given["step"].tolist()} | {c: [v[k]] * beam.n for c, v in keys.items()}).items():
                    out[c] += v
        return pa.table({c: pa.array(v, own.get(c, pa.float64())) for c, v in out.items()})

    kinds = dict(steps.dtypes) | {"cand": dict(grid.dtypes)["cand"]}
    fields = [f"{c} {kinds[c]}" for c in (*trail, "step", "cand")] + [f"{c} double" for c in numbers]
    return on_floors(walks, floors, steps, by, trail, trails_per_task).applyInArrow(search, ", ".join(fields))


def lists(table: pa.Table, column: str) -> tuple[np.ndarray, dict[str, np.ndarray | pa.Array]]:
    """Of a column of lists of structs where each row's list ends, and the fields of all lists as arrays (nested lists as Arrow ones)."""
    col = table[column].combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    fields = {f.name: col.values.field(f.name) for f in col.type.value_type}
    return col.offsets.to_numpy(), {c: v if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False) for c, v in fields.items()}


def on_floors(trails: DataFrame, floors: DataFrame, steps: DataFrame, by: list[str], trail: list[str], trails_per_task: int):
    """``trails`` and the row of their floor in groups that can be worked on: a floor's row goes along once for about ``trails_per_task`` of its trails.

    ``steps`` (by, trail) counts a floor's trails. Groups are dealt to as many tasks
    as there are partitions, as small rows make long searches.
    """
    n = int(trails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = steps.select(*by, *trail).distinct().groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / trails_per_task).cast("int").alias("slices"))
    # Columns of their own, as all may come from one table.
    slices = slices.toDF(*by, "slices")
    placed = trails.join(slices, by).withColumn("slice", F.pmod(F.xxhash64(*trail), F.col("slices")).cast("int")).drop("slices")
    copies = floors.join(slices, by).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return placed.repartition(n, *by, "slice").groupBy(*by, "slice").cogroup(copies.repartition(n, *by, "slice").groupBy(*by, "slice"))


def _straight_runs(p: Column, tolerance: float) -> Column:
    """First and last places of runs of two moves or more on one line whose inner points are ``off`` the known grid, in an ordered array of points."""
    state = "struct<start:int,line:double,runs:array<struct<a:int,b:int>>>"
    empty = F.struct(F.lit(None).cast("int").alias("start"), F.lit(0.0).alias("line"), F.array().cast("array<struct<a:int,b:int>>").alias("runs")).cast(state)
    angle = lambda i, j: F.atan2(p[j]["y"] - p[i]["y"], p[j]["x"] - p[i]["x"])
    close = lambda a, b: F.abs(X.wrap_angle(a - b)) <= tolerance

    def step(s: Column, i: Column) -> Column:
        start, line, runs, now = s["start"], s["line"], s["runs"], angle(i - 1, i)
        new = lambda a, b, r: F.struct(a.cast("int").alias("start"), b.alias("line"), r.alias("runs")).cast(state)
        ended = lambda b: F.concat(runs, F.array(F.struct(start.alias("a"), b.cast("int").alias("b"))))
        out = F.lit(None)
        return (
            F.when(p[i]["off"] & start.isNull(), new(i - 1, now, runs))
            .when(p[i]["off"] & close(line, now), new(start, angle(start, i), runs))
            .when(p[i]["off"], new(i - 1, now, ended(i - 1)))
            .when(start.isNotNull(), new(out, F.lit(0.0), ended(i - 1 + close(angle(start, i), now).cast("int"))))
            .otherwise(s)
        )

    places = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i > 0)
    return F.filter(F.aggregate(places, empty, step)["runs"], lambda r: r["b"] - r["a"] > 1)


def redistribute(points: DataFrame, by: list[str], order: str, off: str, length: str, tolerance: float = 0.05) -> DataFrame:
    """Points (x, y) between the ends of straight runs off the grid, moved along their run in proportion to the wanted ``length`` of the moves to them; ``moved`` marks them.

    One ordered array a trail; its last run stays as it is if the trail ends within it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    row = points.select(*by, F.struct(F.col(order).alias("o"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(off).alias("off"), F.sum(length).over(w).cast("double").alias("way")).alias("p"))
    trails = row.groupBy(*by).agg(F.sort_array(F.collect_list("p")).alias("p"))
    trails = trails.withColumn("runs", _straight_runs(F.col("p"), tolerance))

    def place(i: Column) -> Column:
        r = F.get(F.filter("runs", lambda r: (r["a"] < i) & (i < r["b"])), F.lit(0))
        a, b, q = F.get("p", r["a"]), F.get("p", r["b"]), F.col("p")[i]
        share = (q["way"] - a["way"]) / (b["way"] - a["way"])
        at = lambda c: F.when(r.isNotNull(), a[c] + (b[c] - a[c]) * share).otherwise(q[c])
        return F.struct(q["o"].alias(order), at("x").alias("x"), at("y").alias("y"), r.isNotNull().alias("moved"))

    return trails.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), place)).alias("m")).select(*by, "m.*")
