"""The path optimiser over floors: candidate grids and neighbour lists as tables, and one job that searches all trails of all floors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import geometry as G
from .paths import FORBIDDEN, LEAST_OFFSET_S, NEAR_EXPONENT, NEAR_KEPT, NEAR_POSITIONS, POSITION_POWER, STEP, TABLE, WEIGHTED_EXPONENT, WEIGHTED_SHARE, Beam, Moves, lists, misfit, on_floors, walk_of

#: Penalty of a candidate off the grid and the distance from known ones at which there is none; crowding of generated candidates; bias of a trail's first and last length.
OFF_GRID = 8.0
OFF_GRID_FREE = 10.0
CROWD_RADIUS = 5.0
CROWD_WEIGHT = 4.0
CROWD_MOST = 2.0
FIRST_BIAS = 0.3147
LAST_BIAS = 0.1577
FIRST_LEAST = 1.0

#: Fixed format: the columns of a result after those of floor and trail.
_OWN = ("wifi", "distance", "relative_movement", "absolute_movement", "time_leak", "wall", "wifi_dir", "off_grid", "off_grid_density", "abs_pos_magn")
RESULT = (
    "waypoint_time long", "trajectory_time long", "numeric_floor int", "trajectory_id int", "num_waypoints int", "all_targets_on_waypoints boolean", "actual_on_waypoint boolean",
    "nearest_trajectory_rank int", "nearest_waypoint_x double", "nearest_waypoint_y double", "selected_total_penalty double", "nearest_total_penalty double",
    *(f"{p}_penalty double" for p in _OWN), *(f"nearest_{p}_penalty double" for p in _OWN),
    "min_wifi_distance double", "train_waypoint_pred boolean", "waypoint_type_pred string", "waypoint_type_nearest string", "waypoint_train_count_pred long", "waypoint_train_count_nearest long",
    "mean_dist_uncertainty double", "mean_abs_move_uncertainty double", "segment_dist_pred double", "distance_second double", "penalty_gap_second double", "pred_smallest_known_distance double",
    "rel_move_sensor_pred_x double", "rel_move_sensor_pred_y double", "x_before_optim_pred double", "y_before_optim_pred double", "x_pred double", "y_pred double", "x_actual double", "y_actual double",
    "original_error double", "before_optim_error double", "after_optim_error double",
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
#: The search's penalty of each of ``_OWN``; walls and the magnetometer have no weight in the live settings.
_FROM = {"wifi": "signal", "distance": "distance", "relative_movement": "relative", "absolute_movement": "absolute", "time_leak": "edge", "wifi_dir": "direction", "off_grid": "off_grid", "off_grid_density": "dense"}


def floor_grid(known: DataFrame, generated: DataFrame, by: list[str]) -> DataFrame:
    """A floor's candidates: cand (from 0), x, y, kind, visits, known, nearest_known, density, off_grid, dense.

    ``known`` has the anchors (x, y, trained), ``generated`` points (id, x, y, kind:
    wall or inner). Equal anchors are one candidate; its visits are the trained
    ones, without any its kind is cheat_valid. Known candidates come first by
    place, then walls and inner points by id. Of generated ones the distance to the
    nearest known one and how crowded they are give their penalties; on a floor
    without known ones that of being off the grid is whole.
    """
    places = known.groupBy(*by, "x", "y").agg(F.sum(F.col("trained").cast("long")).alias("visits"))
    old = places.select(*by, "x", "y", F.lit(0).alias("o"), F.lit(0).cast("long").alias("id"), F.when(F.col("visits") > 0, "train").otherwise("cheat_valid").alias("kind"), "visits")
    new = generated.select(*by, "x", "y", F.when(F.col("kind") == "wall", 1).otherwise(2).alias("o"), F.col("id").cast("long").alias("id"), F.concat(F.lit("grid_"), "kind").alias("kind"), F.lit(0).cast("long").alias("visits"))
    order = Window.partitionBy(*by).orderBy("o", "id", "x", "y")
    grid = old.unionByName(new).withColumn("cand", F.row_number().over(order) - 1).withColumn("known", F.col("o") == 0).drop("o", "id")
    own = grid.where("not known").select(*by, "cand", "x", "y")
    rename = lambda df: df.select(*by, F.col("cand").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    nearest = G.knn(own, rename(grid.where("known")), by, "cand", "other", 1).select(*by, "cand", F.col("distance").alias("nearest"))
    crowd = G.near_pairs(own, rename(own), by, CROWD_RADIUS).where("cand != other").groupBy(*by, "cand").agg(F.sum(1 / F.greatest(F.lit(1.0), F.col("distance"))).alias("density"))
    full = grid.join(nearest, [*by, "cand"], "left").join(crowd, [*by, "cand"], "left")
    away = F.when(F.col("known"), 0.0).otherwise(F.col("nearest"))
    density = F.coalesce("density", F.lit(0.0))
    off = F.when(F.col("known"), 0.0).otherwise(F.greatest(F.lit(0.0), OFF_GRID * (1 - F.coalesce("nearest", F.lit(0.0)) / OFF_GRID_FREE)))
    dense = CROWD_WEIGHT * F.least(F.lit(CROWD_MOST), F.greatest(F.lit(0.0), density - 1))
    return full.select(*by, "cand", "x", "y", "kind", "visits", "known", away.alias("nearest_known"), density.alias("density"), off.alias("off_grid"), dense.alias("dense"))


def neighbour_lists(grid: DataFrame, by: list[str], reach: float) -> DataFrame:
    """Of every candidate (cand, x, y) the others within ``reach``, nearest first: ``near``, an array of distance, cand, dx, dy, angle.

    Pairs meet on cells. A candidate without neighbours has an empty array.
    """
    other = grid.select(*by, F.col("cand").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = G.near_pairs(grid.select(*by, "cand", "x", "y"), other, by, reach).where("cand != other")
    dx, dy = F.col("rx") - F.col("x"), F.col("ry") - F.col("y")
    one = F.struct("distance", F.col("other").alias("cand"), dx.alias("dx"), dy.alias("dy"), F.atan2(dy, dx).alias("angle"))
    lists = pairs.groupBy(*by, "cand").agg(F.sort_array(F.collect_list(one)).alias("near"))
    return grid.select(*by, "cand").join(lists, [*by, "cand"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<distance:double,cand:int,dx:double,dy:double,angle:double>>")))


class Floor:
    """A floor's candidates, the moves between them and their nearest known positions, as arrays."""

    def __init__(self, grid: dict[str, np.ndarray], pos: np.ndarray, positions: np.ndarray, reach: float, nearest: int = NEAR_POSITIONS, table: int = TABLE):
        """``grid`` has columns of candidates, ``pos`` numbers and ``positions`` places of known positions."""
        order = np.argsort(grid["cand"], kind="stable")
        grid = {c: v[order] for c, v in grid.items()}
        self.cand, self.pos = grid["cand"], np.stack([grid["x"], grid["y"]], 1)
        self.kind, self.known, self.visits, self.nearest_known = (grid[c] for c in ("kind", "known", "visits", "nearest_known"))
        self.fixed = {c: grid[c] for c in ("off_grid", "dense")}
        order = np.argsort(pos, kind="stable")
        self.names, self.positions = pos[order], positions[order]
        way = np.hypot(*(self.pos[:, None] - self.positions[None]).transpose(2, 0, 1))
        self.near = np.argsort(way, axis=1, kind="stable")[:, :nearest]
        self.reach, self.moves = reach, Moves(self.pos, table)
        self.next = self._next() if self.moves.whole is None else None

    def _next(self) -> np.ndarray:
        """Of every candidate the others in reach by number, so that ties go as they do among all candidates; -1 where there are no more."""
        order = np.argsort(self.pos[:, 0], kind="stable")
        x = self.pos[order, 0]
        low, high = np.searchsorted(x, self.pos[:, 0] - self.reach), np.searchsorted(x, self.pos[:, 0] + self.reach, "right")
        lists = []
        for i, (a, b) in enumerate(zip(low, high, strict=True)):
            own = np.sort(order[a:b])
            lists.append(own[(np.hypot(*(self.pos[own] - self.pos[i]).T) <= self.reach) & (own != i)])
        out = np.full((len(lists), max(map(len, lists), default=0)), -1)
        for i, own in enumerate(lists):
            out[i, : len(own)] = own
        return out

    def signals(self, at: np.ndarray, far: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By step: the signal penalty of every candidate, the weighted position, and the least distance of the scans around.

        ``at`` are times of scans in order, ``far`` their distances by position.
        """
        small = np.sort(far[:, self.near], axis=2)[:, :, :NEAR_KEPT]
        value = 1.5 * small.mean(2) + 1.5 * small[:, :, 0]
        least = value.min(1)
        top = np.argsort(far, axis=1, kind="stable")[:, :NEAR_POSITIONS]
        d = np.take_along_axis(far, top, 1)
        weight = ((d + 1e-5) / (d[:, :1] + 1e-5)) ** -POSITION_POWER
        spot = (weight[..., None] * self.positions[top]).sum(1) / weight.sum(1)[:, None]
        way = np.hypot(*(spot[:, None] - self.pos[None]).transpose(2, 0, 1))
        n = (at[None] < times[:, None]).sum(1)
        low, high = np.maximum(0, n - 1), np.minimum(len(at) - 1, n)
        wl, wh = (1 / np.maximum(LEAST_OFFSET_S, np.abs(at[k] - times) / 1000) for k in (low, high))
        both = lambda v: (wl[:, None] * v[low] + wh[:, None] * v[high]) / (wl + wh)[:, None]
        off = way - way.min(1)[:, None]
        penalty = (wl + wh)[:, None] * np.minimum(both(value - least[:, None]) ** NEAR_EXPONENT, WEIGHTED_SHARE * ((off[low] + off[high]) / 2) ** WEIGHTED_EXPONENT)
        return penalty, (spot[low] + spot[high]) / 2, both(least[:, None])[:, 0]


class FloorBeam(Beam):
    """A beam that on a large floor looks among a candidate's neighbours first, and follows the path of nearest candidates where the truth is known."""

    def __init__(self, floor: Floor, walk: dict[str, np.ndarray], signal: np.ndarray, width: int, by_signal: int, by_move: int, truth: np.ndarray | None):
        super().__init__(walk, floor.cand, floor.moves, floor.fixed, signal, width, by_signal, by_move)
        self.floor, self.follow = floor, None
        if truth is not None:
            self.follow = np.zeros(len(truth), np.int64)
            for i, p in enumerate(truth):
                far = ((self.pos - p) ** 2).sum(1)
                if i:
                    far[self.follow[i - 1]] += FORBIDDEN
                self.follow[i] = far.argmin()

    def first(self) -> None:
        super().first()
        self.row = None
        if self.follow is None:
            return
        at = np.flatnonzero(self.path[:, 0] == self.follow[0])
        if not len(at):
            # It takes the last place of the beam.
            c, k = self.follow[0], len(self.path) - 1
            self.path[k, 0] = c
            for p, v in {"signal": self.signal[0], **self.fixed}.items():
                self.parts[0][p][k] = v[c]
            self.total[k] = sum(v[k] for v in self.parts[0].values())
            at = [k]
        self.row = int(at[0])

    def fits(self, i: int, last: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Among neighbours in reach; among all where a candidate beyond it could fit as well."""
        step, floor = self.steps[i], self.floor
        # A move beyond the reach misses the wanted length and place by so much at least.
        bound = 4 * max(0.0, floor.reach - step["distance"]) + max(0.0, floor.reach - math.hypot(step["ax"], step["ay"]))
        if floor.next is None:
            return self._fits_in_all(step, last, best, bound)
        nxt = floor.next[last]
        dx, dy = (self.pos[nxt] - self.pos[last][:, None]).transpose(2, 0, 1)
        error = misfit(step, dx, dy, np.hypot(dx, dy), np.arctan2(dy, dx))
        is_best = np.zeros(len(self.cand), bool)
        is_best[best] = True
        error[(nxt < 0) | is_best[nxt]] = np.inf
        fit, ok = np.zeros((len(last), self.by_move), np.int64), np.zeros((len(last), self.by_move), bool)
        order = np.argsort(error, axis=1, kind="stable")[:, : self.by_move]
        k = order.shape[1]
        fit[:, :k], got = np.take_along_axis(nxt, order, 1), np.take_along_axis(error, order, 1)
        ok[:, :k] = np.isfinite(got)
        rest = np.flatnonzero(~((k == self.by_move) & (got[:, -1] < bound))) if k else np.arange(len(last))
        if len(rest):
            wide, there = super().fits(i, last[rest], best)
            fit[rest], ok[rest] = 0, False
            fit[rest, : wide.shape[1]], ok[rest, : wide.shape[1]] = wide, there
        return fit, ok

    def _fits_in_all(self, step: dict, last: np.ndarray, best: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """``fits`` where all moves are at hand: staying is one only where those in reach do not settle it."""
        error, at = misfit(step, *self.moves.to_all(last)), np.arange(len(last))
        error[:, best] = np.inf
        stay = error[at, last]
        error[at, last] = np.inf
        fit = np.argsort(error, axis=1, kind="stable")[:, : self.by_move]
        got = np.take_along_axis(error, fit, 1)
        rest = np.flatnonzero(np.isfinite(stay) & ~((fit.shape[1] == self.by_move) & (got[:, -1] < bound)))
        if len(rest):
            error[at, last] = stay
            fit[rest] = np.argsort(error[rest], axis=1, kind="stable")[:, : self.by_move]
            got[rest] = np.take_along_axis(error[rest], fit[rest], 1)
        return fit, np.isfinite(got)

    def expand(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        row, nxt = super().expand(i)
        self.forced = None
        if self.follow is not None:
            own = np.flatnonzero((row == self.row) & (nxt == self.follow[i]))
            if not len(own):
                self.forced = int(np.flatnonzero(row == self.row)[-1])
                nxt[self.forced] = self.follow[i]
        return row, nxt

    def keep(self, i: int, row: np.ndarray, nxt: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.follow is None:
            return super().keep(i, row, nxt, total)
        own = int(np.flatnonzero((row == self.row) & (nxt == self.follow[i]))[0])
        if self.forced is not None:
            total[self.forced] += FORBIDDEN
        keep = super().keep(i, row, nxt, total)
        at = np.flatnonzero(keep == own)
        if not len(at):
            # It dropped out: kept for the report, it must not come back.
            total[own] += FORBIDDEN
            keep, at = np.append(keep, own), [len(keep)]
        self.row = int(at[0])
        return keep


def _report(floor: Floor, beam: FloorBeam, walk: dict[str, np.ndarray], truth: dict[str, np.ndarray], before: np.ndarray, least: np.ndarray) -> dict[str, list]:
    """The columns ``RESULT`` of a trail; ``walk`` as given, not as corrected."""
    n, one, time = beam.n, beam.path[0], walk["time"]

    def trace(k: int) -> dict[str, list[float]]:
        own = beam.trace(k)
        return {p: own[_FROM[p]] if p in _FROM else [0.0] * n for p in _OWN}

    own, x = trace(0), beam.pos[one]
    second = beam.path[1] if len(beam.path) > 1 else None
    mean = lambda c: [float(walk[c][1:].mean()) if n > 1 else None] * n
    out = {
        "waypoint_time": time.tolist(), "trajectory_time": (time - time[0]).tolist(), "numeric_floor": walk["numeric_floor"].tolist(), "trajectory_id": list(range(n)), "num_waypoints": [n] * n,
        "selected_total_penalty": np.sum(list(own.values()), axis=0).tolist(), **{f"{p}_penalty": v for p, v in own.items()},
        "min_wifi_distance": least.tolist(), "train_waypoint_pred": floor.known[one].tolist(), "waypoint_type_pred": floor.kind[one].tolist(), "waypoint_train_count_pred": floor.visits[one].tolist(),
        "mean_dist_uncertainty": mean("spread"), "mean_abs_move_uncertainty": mean("move_spread"),
        "segment_dist_pred": [None, *walk["distance"][1:].tolist()], "rel_move_sensor_pred_x": [None, *walk["ax"][1:].tolist()], "rel_move_sensor_pred_y": [None, *walk["ay"][1:].tolist()],
        "distance_second": [None if second is None else float(np.hypot(*(x - beam.pos[second]).T).sum())] * n, "penalty_gap_second": [None if second is None else float(beam.total[1] - beam.total[0])] * n,
        "pred_smallest_known_distance": floor.nearest_known[one].tolist(), "x_before_optim_pred": before[:, 0].tolist(), "y_before_optim_pred": before[:, 1].tolist(), "x_pred": x[:, 0].tolist(), "y_pred": x[:, 1].tolist(),
    }
    if beam.follow is not None:
        near, other = beam.follow, trace(beam.row)
        true, original = (np.stack([truth[f"{a}_{side}"] for a in "xy"], 1) for side in ("actual", "original"))
        on = (((beam.pos[None] - true[:, None]) ** 2).sum(2).min(1) == 0).tolist()
        error = lambda p: np.hypot(*(p - true).T).tolist()
        out |= {
            "all_targets_on_waypoints": [all(on)] * n, "actual_on_waypoint": on, "nearest_trajectory_rank": [beam.row] * n, "nearest_waypoint_x": beam.pos[near, 0].tolist(), "nearest_waypoint_y": beam.pos[near, 1].tolist(),
            "nearest_total_penalty": np.sum(list(other.values()), axis=0).tolist(), **{f"nearest_{p}_penalty": v for p, v in other.items()}, "waypoint_type_nearest": floor.kind[near].tolist(), "waypoint_train_count_nearest": floor.visits[near].tolist(),
            "x_actual": true[:, 0].tolist(), "y_actual": true[:, 1].tolist(), "original_error": error(original), "before_optim_error": error(before), "after_optim_error": error(x),
        }
    return out


def optimise_floors(steps: DataFrame, distances: DataFrame, grid: DataFrame, by: list[str], trail: list[str], **options) -> DataFrame:
    """``optimise_scans`` of ``distances`` in rows (by, trail, scan, pos, px, py, distance): of each scan to every known position of the floor."""
    scans = distances.groupBy(*by, *trail, "scan").agg(F.collect_list(F.struct("pos", "distance")).alias("to"))
    return optimise_scans(steps, scans, distances.select(*by, "pos", "px", "py").distinct(), grid, by, trail, **options)


def optimise_scans(steps: DataFrame, scans: DataFrame, positions: DataFrame, grid: DataFrame, by: list[str], trail: list[str], reach: float = 40.0, width: int = 200, by_signal: int = 10, by_move: int = 40, unbias: bool = False, trails_per_task: int = 64, distance: Callable[[dict, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The best path of every trail on every floor in one job, a row a step with the columns ``by``, ``trail`` and ``RESULT``.

    ``steps``: by, trail, step, time (ms), numeric_floor and the columns of
    ``paths.STEP`` but the signal's position; where the truth is known also x_actual, y_actual,
    x_original, y_original (null or missing otherwise; then all that compares with
    them is null). ``scans``: by, trail, scan (ms), ``to``, an array of pos and
    distance to every known position of the floor; ``positions``: by, pos, px, py.
    ``grid``: ``floor_grid``'s rows. With ``distance`` a scan has other columns in place
    of ``to``, and the function makes of them and of px and py the distances by scan
    and position.

    A floor is one row: its candidates and its positions as arrays. It goes to a
    task once for each ``trails_per_task`` of its trails, so a crowded floor is many
    tasks, and no row is made for a trail's step and candidate or scan and position.
    Moves between candidates are worked out in the task; on floors of more than
    ``paths.TABLE`` candidates those within ``reach`` are tried first. Trails without
    scans, or of floors without candidates, give no rows. With ``unbias`` first and
    last lengths are corrected before the search.
    """
    key = [*by, *trail]
    truth = ["x_actual", "y_actual", "x_original", "y_original"]
    steps = steps.withColumns({c: F.lit(None).cast("double") for c in truth if c not in steps.columns})
    asked = [c for c in STEP[1:] if c not in ("wx", "wy")]
    walks = steps.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("step", "time", "numeric_floor", *asked, *truth))).alias("steps"))
    to = [*sorted(set(scans.columns) - {*key, "scan"})] if distance else F.transform("to", lambda t: F.struct(t["pos"].cast("long").alias("pos"), t["distance"].cast("double").alias("distance"))).alias("to")
    to = to if distance else [to]
    heard = scans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("scan", *to))).alias("scans"))
    cells = ["cand", "x", "y", "kind", "visits", "known", "nearest_known", "off_grid", "dense"]
    where = positions.groupBy(*by).agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))).alias("positions"))
    floors = grid.groupBy(*by).agg(F.collect_list(F.struct(*cells)).alias("grid")).join(where.toDF(*by, "positions"), by)
    kinds = dict(steps.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), *RESULT])
    names = [*key, *(c.split()[0] for c in RESULT)]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in names}
        if left.num_rows and right.num_rows:
            _, cand = lists(right, "grid")
            _, at = lists(right, "positions")
            floor = Floor(cand, at["pos"], np.stack((at["px"], at["py"]), 1), reach)
            ends, every = lists(left, "steps")
            keys = {c: left[c].to_pylist() for c in key}
            scan_ends, scan = lists(left, "scans")
            if not distance:
                to, far_ends = scan["to"].values, scan["to"].offsets.to_numpy()
                pos, value = np.searchsorted(floor.names, to.field("pos").to_numpy()), to.field("distance").to_numpy()
            for k in range(left.num_rows):
                given = {c: v[ends[k] : ends[k + 1]] for c, v in every.items()}
                a, b = scan_ends[k], scan_ends[k + 1]
                if distance:
                    far = distance({c: v[a:b] for c, v in scan.items()}, *floor.positions.T)
                else:
                    far = np.full((b - a, len(floor.positions)), np.inf)
                    low, high = far_ends[a], far_ends[b]
                    far[np.repeat(np.arange(b - a), np.diff(far_ends[a : b + 1])), pos[low:high]] = value[low:high]
                signal, before, least = floor.signals(scan["scan"][a:b], far, given["time"])
                walk = walk_of({c: given[c] for c in asked}) | {"wx": before[:, 0], "wy": before[:, 1]}
                true = {c: given[c].astype(float) for c in truth}
                known = not np.isnan(np.stack(list(true.values()))).any()
                if unbias and len(before) > 1:
                    walk["distance"] = walk["distance"].copy()
                    walk["distance"][1] = max(FIRST_LEAST, walk["distance"][1] - FIRST_BIAS)
                    walk["distance"][-1] += LAST_BIAS
                beam = FloorBeam(floor, walk, signal, width, by_signal, by_move, np.stack((true["x_actual"], true["y_actual"]), 1) if known else None)
                beam.search()
                rows = _report(floor, beam, given, true, before, least) | {c: [v[k]] * beam.n for c, v in keys.items()}
                for c in names:
                    out[c] += rows.get(c, [None] * beam.n)
        own = {c: left.schema.field(c).type for c in key} | {c: _ARROW[t] for c, t in (x.split() for x in RESULT)}
        return pa.table({c: pa.array(v, own[c]) for c, v in out.items()})

    return on_floors(walks.join(heard, key), floors, steps, by, trail, trails_per_task).applyInArrow(search, schema)


def for_submission(results: DataFrame) -> DataFrame:
    """Results where no truth is known: without the columns that compare with it."""
    return results.drop(*[c for c in results.columns if any(w in c for w in ("actual", "error", "target", "nearest"))])
