"""Candidate grids, neighbour lists and the search over floors against plain loops and the search by given candidates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import floors as L
from trailmark.operators import paths as O

BY, TRAIL = ["site", "floor"], ["fn"]


def world(spark, seed=3, floors=3, trails=5, scans=4, n_known=14, n_new=16):
    rng = np.random.default_rng(seed)
    known, new, dist, steps = [], [], [], []
    for f in range(floors):
        places = rng.uniform(0, 30, (n_known, 2)).round(1)
        known += [("s", f, float(x), float(y), bool(rng.integers(4))) for x, y in np.concatenate((places, places[:5]))]
        new += [("s", f, i, *map(float, rng.uniform(0, 30, 2).round(1)), ["wall", "inner"][i % 2]) for i in range(n_new)]
        spots = rng.uniform(0, 30, (25, 2))
        for t in range(trails + 4 * (f == 0)):
            fn = f"t{f}_{t}"
            for k in range(scans):
                dist += [("s", f, fn, 1000 * k + t, p, *map(float, spots[p]), float(rng.uniform(2, 20))) for p in range(25)]
            n = 1 + t % 4
            for i in range(n):
                ax, ay, rx, ry = map(float, rng.normal(0, 5, 4))
                true = places[rng.integers(n_known)] if t % 2 else rng.uniform(0, 30, 2)
                edge = [v for _ in range(2) for v in (bool(rng.integers(2)), *map(float, (rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(1, 20), rng.uniform(5, 40))))]
                steps.append(("s", f, fn, i, 900 * i + 77, f + 1, float(rng.uniform(2, 12)), ax, ay, rx, ry, float(rng.uniform(0.05, 0.3)), float(rng.uniform(0.05, 0.3)), *edge, *map(float, true), *map(float, rng.uniform(0, 30, 2))))
    kinds = ", ".join(f"{c} {'boolean' if 'reliable' in c else 'double'}" for c in O.STEP[1:] if c not in ("wx", "wy"))
    return (
        spark.createDataFrame(known, "site string, floor int, x double, y double, trained boolean"),
        spark.createDataFrame(new, "site string, floor int, id long, x double, y double, kind string"),
        spark.createDataFrame(dist, "site string, floor int, fn string, scan long, pos int, px double, py double, distance double"),
        spark.createDataFrame(steps, f"site string, floor int, fn string, step int, time long, numeric_floor int, {kinds}, x_actual double, y_actual double, x_original double, y_original double"),
    )


def test_floor_grid(spark):
    known, new, *_ = world(spark)
    got = {}
    for r in L.floor_grid(known, new, BY).collect():
        got.setdefault(r.floor, []).append(r)
    for f, rows in got.items():
        rows.sort(key=lambda r: r.cand)
        assert [r.cand for r in rows] == list(range(len(rows)))
        seen = {}
        for r in known.where(F.col("floor") == f).collect():
            seen[r.x, r.y] = seen.get((r.x, r.y), 0) + r.trained
        made = sorted(new.where(F.col("floor") == f).collect(), key=lambda r: (r.kind != "wall", r.id))
        want = [(x, y, "train" if n else "cheat_valid", n) for (x, y), n in sorted(seen.items())] + [(r.x, r.y, f"grid_{r.kind}", 0) for r in made]
        assert [(r.x, r.y, r.kind, r.visits) for r in rows] == want
        for r in rows:
            if r.known:
                assert (r.nearest_known, r.density, r.off_grid, r.dense) == (0, 0, 0, 0)
                continue
            near = min(math.dist((r.x, r.y), p) for p in seen)
            crowd = sum(1 / max(1, d) for o in made for d in [math.dist((r.x, r.y), (o.x, o.y))] if (o.x, o.y) != (r.x, r.y) and d <= 5)
            assert r.nearest_known == pytest.approx(near) and r.density == pytest.approx(crowd)
            assert r.off_grid == pytest.approx(max(0, 8 * (1 - near / 10))) and r.dense == pytest.approx(4 * min(2, max(0, crowd - 1)))


def test_floor_grid_without_known(spark):
    known, new, *_ = world(spark, floors=1)
    got = L.floor_grid(known.where("false"), new, BY).collect()
    assert {r.off_grid for r in got} == {8.0} and {r.nearest_known for r in got} == {None}


def test_neighbour_lists(spark):
    known, new, *_ = world(spark)
    grid = L.floor_grid(known, new, BY)
    at = {(r.floor, r.cand): (r.x, r.y) for r in grid.collect()}
    for r in L.neighbour_lists(grid, BY, 6.0).collect():
        want = sorted((math.dist(at[r.floor, r.cand], p), c) for (f, c), p in at.items() if f == r.floor and c != r.cand and math.dist(at[r.floor, r.cand], p) <= 6)
        assert [n.cand for n in r.near] == [c for _, c in want]
        for n in r.near:
            p, q = at[r.floor, r.cand], at[r.floor, n.cand]
            assert (n.dx, n.dy) == (q[0] - p[0], q[1] - p[1]) and n.angle == pytest.approx(math.atan2(n.dy, n.dx))


@pytest.mark.parametrize(("reach", "per_task"), [(3.0, 64), (12.0, 2), (60.0, 1)])
def test_floors_as_given_candidates(spark, reach, per_task):
    """The same paths and penalties as the search whose candidates and signals are rows."""
    known, new, dist, steps = world(spark)
    grid = L.floor_grid(known, new, BY).cache()
    got = L.optimise_floors(steps.drop("x_actual", "y_actual"), dist, grid, BY, TRAIL, reach=reach, width=25, by_signal=5, by_move=6, trails_per_task=per_task)
    signal = O.signal_penalties(dist, grid.select(*BY, "cand", "x", "y"), steps.select(*BY, *TRAIL, "step", "time"), BY, TRAIL)
    spots = signal.select(*BY, *TRAIL, "step", "wx", "wy").distinct()
    cells = signal.join(grid.select(*BY, "cand", "x", "y", "off_grid", "dense"), [*BY, "cand"])
    want = O.search_paths(steps.join(spots, [*BY, *TRAIL, "step"]), cells, [*BY, *TRAIL], width=25, by_signal=5, by_move=6)
    want = {(r.floor, r.fn, r.step): r for r in want.collect()}
    have = got.collect()
    assert len(have) == len(want) == steps.count()
    assert sum(c.split()[0] in got.columns for c in L.RESULT) == len(L.RESULT) == 58 - len(BY) - len(TRAIL)
    for r in have:
        w = want[r.floor, r.fn, r.trajectory_id]
        assert (r.x_pred, r.y_pred) == (w.x, w.y)
        for own, theirs in L._FROM.items():
            assert r[f"{own}_penalty"] == pytest.approx(w[theirs], rel=1e-9, abs=1e-9)
        assert r.penalty_gap_second == pytest.approx(w.gap_second, abs=1e-6) and r.distance_second == pytest.approx(w.distance_second)
        assert r.after_optim_error is None and r.nearest_trajectory_rank is None
    assert not {"x_actual", "before_optim_error", "nearest_waypoint_x", "all_targets_on_waypoints"} & set(L.for_submission(got).columns)
    assert "x_before_optim_pred" in L.for_submission(got).columns


def test_floors_with_truth(spark):
    known, new, dist, steps = world(spark)
    grid = L.floor_grid(known, new, BY).cache()
    free = {(r.fn, r.trajectory_id): r for r in L.optimise_floors(steps.drop("x_actual"), dist, grid, BY, TRAIL, width=8, by_signal=3, by_move=3).collect()}
    at = {}
    for r in grid.collect():
        at.setdefault(r.floor, {})[r.cand] = r
    true = {(r.fn, r.step): r for r in steps.collect()}
    got = {}
    for r in L.optimise_floors(steps, dist, grid, BY, TRAIL, width=8, by_signal=3, by_move=3).collect():
        got.setdefault((r.floor, r.fn), []).append(r)
    ranks = set()
    for (f, fn), rows in got.items():
        rows.sort(key=lambda r: r.trajectory_id)
        last = None
        on = []
        for i, r in enumerate(rows):
            s = true[fn, i]
            far = {c: (g.x - s.x_actual) ** 2 + (g.y - s.y_actual) ** 2 + 1e6 * (c == last) for c, g in at[f].items()}
            on.append(min((g.x - s.x_actual) ** 2 + (g.y - s.y_actual) ** 2 for g in at[f].values()) == 0)
            last = min(far, key=lambda c: (far[c], c))
            assert (r.nearest_waypoint_x, r.nearest_waypoint_y, r.waypoint_type_nearest) == (at[f][last].x, at[f][last].y, at[f][last].kind)
            assert r.after_optim_error == pytest.approx(math.dist((r.x_pred, r.y_pred), (s.x_actual, s.y_actual)))
            assert r.original_error == pytest.approx(math.dist((s.x_original, s.y_original), (s.x_actual, s.y_actual)))
            assert r.before_optim_error == pytest.approx(math.dist((r.x_before_optim_pred, r.y_before_optim_pred), (s.x_actual, s.y_actual)))
        assert [r.actual_on_waypoint for r in rows] == on and {r.all_targets_on_waypoints for r in rows} == {all(on)}
        ranks.add(rows[0].nearest_trajectory_rank)
        # Where the nearest path was in the beam anyway, following it changes nothing.
        if len(rows) == 1 and rows[0].nearest_trajectory_rank < 7:
            assert rows[0].x_pred == free[fn, 0].x_pred
    assert ranks > {8}


def test_floors_unbias_and_gaps(spark):
    known, new, dist, steps = world(spark)
    grid = L.floor_grid(known, new, BY).cache()
    one = L.optimise_floors(steps, dist.where("fn != 't1_1'"), grid.where("floor < 2"), BY, TRAIL, width=8, unbias=True)
    # A trail without scans and a floor without candidates give no rows; the report has the lengths as given.
    assert {r.floor for r in one.collect()} == {0, 1} and not one.where("fn = 't1_1'").count()
    want = {(r.fn, r.step): r.distance for r in steps.collect()}
    assert all(r.segment_dist_pred == (want[r.fn, r.trajectory_id] if r.trajectory_id else None) for r in one.collect())


def test_large_floors_find_the_same_paths():
    """Neighbours first, as on floors of more than TABLE candidates, and all moves at once, as on smaller ones."""
    rng = np.random.default_rng(5)
    n, spots = 60, rng.uniform(0, 40, (9, 2))
    grid = {"cand": np.arange(n), "x": rng.integers(0, 40, n).astype(float), "y": rng.integers(0, 40, n).astype(float), "kind": np.array(["train"] * n, object), "visits": np.zeros(n, int), "known": np.ones(n, bool), "nearest_known": np.zeros(n)}
    grid |= {"off_grid": rng.uniform(0, 3, n), "dense": rng.uniform(0, 3, n)}
    walk = {c: rng.uniform(1, 9, 6) for c in O.STEP[1:]} | {c: np.array([True] * 6) for c in O.STEP[1:] if c.endswith("reliable")}
    for reach in (2.0, 9.0, 25.0):
        small, large = (L.Floor(grid, np.arange(9), spots, reach, table=t) for t in (n, n - 1))
        assert small.next is None and (large.next >= 0).any()
        for truth in (None, rng.uniform(0, 40, (6, 2))):
            signal = rng.uniform(0, 9, (6, n))
            a, b = (L.FloorBeam(f, walk, signal, 12, 3, 5, truth) for f in (small, large))
            a.search()
            b.search()
            assert (a.path == b.path).all() and np.allclose(a.total, b.total, rtol=1e-12)
            assert a.trace(0).keys() == set(O.PENALTIES) and sum(map(sum, a.trace(0).values())) == pytest.approx(a.total[0] % 1e6)


def test_scans_with_a_distance_as_with_rows(spark):
    """The paths do not depend on whether distances come as rows or are worked out where they are used."""
    known, new, dist, steps = world(spark)
    grid = L.floor_grid(known, new, BY).cache()
    options = {"width": 8, "by_signal": 3, "by_move": 3, "trails_per_task": 2}
    far = lambda s, px, py: 2 + np.hypot(s["hx"][:, None] - px, s["hy"][:, None] - py)
    scans = dist.groupBy(*BY, *TRAIL, "scan").agg(F.avg("distance").alias("hx"), F.max("distance").alias("hy"))
    rows = dist.join(scans, [*BY, *TRAIL, "scan"]).withColumn("distance", 2 + F.hypot(F.col("hx") - F.col("px"), F.col("hy") - F.col("py")))
    got = L.optimise_scans(steps, scans, dist.select(*BY, "pos", "px", "py").distinct(), grid, BY, TRAIL, distance=far, **options).collect()
    want = L.optimise_floors(steps, rows.drop("hx", "hy"), grid, BY, TRAIL, **options).collect()
    at = lambda found: sorted((r.floor, r.fn, r.trajectory_id, r.x_pred, r.y_pred, round(r.selected_total_penalty, 6)) for r in found)
    assert at(got) == at(want) and len(got) == steps.count()
