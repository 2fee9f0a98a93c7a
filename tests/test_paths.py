"""The path optimiser against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import paths as O


def turn(a):
    return abs((a + math.pi) % (2 * math.pi) - math.pi)


def cost(steps, grid, signal, path):
    """All penalties of one path, written out for a single one."""
    total = 0.0
    for i, c in enumerate(path):
        s, (x, y, off, dense) = steps[i], grid[c]
        total += signal[i][c] + off + dense
        if not i:
            continue
        px, py = grid[path[i - 1]][:2]
        mx, my = x - px, y - py
        d, want = math.hypot(mx, my), s["distance"]
        total += 1e6 * (path[i] == path[i - 1])
        total += min(4, 0.12 / s["spread"]) * 30 / 5 * abs(d - want) / (1.4 * (1 - 1 / (want**0.5 + 0.5)))
        wx, wy = s["wx"] - steps[i - 1]["wx"], s["wy"] - steps[i - 1]["wy"]
        n = math.hypot(wx, wy)
        total -= 0.5 * math.sqrt(n) * (mx * wx + my * wy) / ((n + 1e-9) * (d + 1e-9))
        cum = []
        for j in range(i):
            gx = sum(steps[t]["ax"] for t in range(j + 1, i + 1))
            gy = sum(steps[t]["ay"] for t in range(j + 1, i + 1))
            cum.append((abs(x - grid[path[j]][0] - gx) + abs(y - grid[path[j]][1] - gy)) / math.sqrt(i - j))
        a = 1.5 * (abs(mx - s["ax"]) + abs(my - s["ay"])) + sum(cum) / len(cum) + 1e6 * (turn(math.atan2(my, mx) - math.atan2(s["ay"], s["ax"])) > math.pi / 2)
        total += min(4, 0.2 / s["move_spread"]) * a
        if i > 1:
            qx, qy = grid[path[i - 2]][:2]
            bend = math.atan2(my, mx) - math.atan2(py - qy, px - qx)
            total += 9 * turn(math.atan2(s["ry"], s["rx"]) - bend)
        ends = ([("before", path[0])] if i == 1 else []) + ([("after", c)] if i == len(path) - 1 else [])
        for side, at in ends:
            t = s[f"{side}_delay_s"]
            if s[f"{side}_reliable"] and 0 < t < 15:
                away = math.hypot(grid[at][0] - s[f"{side}_x"], grid[at][1] - s[f"{side}_y"])
                q = s[f"{side}_dissimilarity"]
                doubt = 1 if q <= 15 else max(0, 1 - ((q - 15) / 15) ** 1.5)
                total += min(30, doubt / (1 + t / 20) * (5 * (away > 1e-3) + max(0, 2 * (away / (math.log2(t + 1) * 0.7) - 1)) ** 2))
    return total


def make(rng, n_steps, n_cands, trail):
    steps, cells = [], []
    grid = {c: (*rng.uniform(0, 20, 2), float(rng.choice([0, 3])), float(rng.choice([0, 1]))) for c in range(n_cands)}
    signal = rng.uniform(0, 12, (n_steps, n_cands))
    for i in range(n_steps):
        ax, ay, rx, ry = rng.normal(0, 4, 4)
        s = {"distance": float(rng.uniform(1, 9)), "ax": ax, "ay": ay, "rx": rx, "ry": ry, "spread": float(rng.uniform(0.02, 0.3)), "move_spread": float(rng.uniform(0.03, 0.4)), "wx": float(rng.uniform(0, 20)), "wy": float(rng.uniform(0, 20))}
        for side in ("before", "after"):
            s |= {f"{side}_reliable": bool(rng.integers(2)), f"{side}_x": float(rng.uniform(0, 20)), f"{side}_y": 5.0, f"{side}_delay_s": float(rng.uniform(0.5, 20)), f"{side}_dissimilarity": float(rng.uniform(5, 40))}
        steps.append(s)
        cells += [(trail, i, c, *grid[c][:2], float(signal[i][c]), *grid[c][2:]) for c in grid]
    return steps, cells, grid, signal


def test_search_finds_the_cheapest_of_all_paths(spark):
    rng = np.random.default_rng(11)
    made = {t: make(rng, 1 + t % 4, 5, t) for t in range(9)}
    rows = [(t, i, *[s[c] for c in O.STEP[1:]]) for t, (steps, *_) in made.items() for i, s in enumerate(steps)]
    kinds = ", ".join(f"{c} {'boolean' if 'reliable' in c else 'double'}" for c in O.STEP[1:])
    steps = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows], f"trail long, step int, {kinds}")
    cells = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for _, (_, c, *_) in made.items() for r in c], "trail long, step int, cand int, x double, y double, signal double, off_grid double, dense double")
    got = {}
    for r in O.search_paths(steps, cells, ["trail"], width=5**4, by_signal=5, by_move=5).collect():
        got.setdefault(r.trail, []).append(r)
    for t, (steps_, _, grid, signal) in made.items():
        mine = sorted(got[t], key=lambda r: r.step)
        every = sorted(cost(steps_, grid, signal, p) for p in itertools.product(range(5), repeat=len(steps_)))
        assert mine[0].total == pytest.approx(every[0], rel=1e-9, abs=1e-6)
        assert cost(steps_, grid, signal, [r.cand for r in mine]) == pytest.approx(every[0], rel=1e-9, abs=1e-6)
        # The penalties of the steps are those of the total (a repeat is not among them).
        assert sum(r[p] for r in mine for p in O.PENALTIES) == pytest.approx(every[0] % 1e6, rel=1e-6, abs=1e-3) or every[0] > 1e6
        assert mine[0].gap_second == pytest.approx(every[1] - every[0], rel=1e-9, abs=1e-6)


def test_search_keeps_its_beam(spark):
    """A narrow beam follows the same rule as plain loops over its own expansion."""
    rng = np.random.default_rng(12)
    steps, cells, grid, signal = make(rng, 5, 12, 1)
    rows = [(1, i, *[float(s[c]) if not isinstance(s[c], bool) else s[c] for c in O.STEP[1:]]) for i, s in enumerate(steps)]
    kinds = ", ".join(f"{c} {'boolean' if 'reliable' in c else 'double'}" for c in O.STEP[1:])
    a = spark.createDataFrame(rows, f"trail long, step int, {kinds}")
    b = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in cells], "trail long, step int, cand int, x double, y double, signal double, off_grid double, dense double")
    got = sorted(O.search_paths(a, b, ["trail"], width=4, by_signal=3, by_move=2).collect(), key=lambda r: r.step)
    beam = [[c] for _, c in sorted((signal[0][c], c) for c in grid)[:4]]
    for i in range(1, 5):
        s, wide = steps[i], []
        best = sorted(grid, key=lambda c: (signal[i][c], c))[:3]
        for p in beam:
            fit = []
            for c in grid:
                mx, my = grid[c][0] - grid[p[-1]][0], grid[c][1] - grid[p[-1]][1]
                if c not in best and turn(math.atan2(my, mx) - math.atan2(s["ay"], s["ax"])) <= math.pi / 4:
                    fit.append((abs(mx - s["ax"]) + abs(my - s["ay"]) + 4 * abs(math.hypot(mx, my) - s["distance"]), c))
            wide += [[*p, c] for c in [*best, *(c for _, c in sorted(fit)[:2])]]
        # A shorter path's last anchor is not its trail's: edges at the end count at step 4 only.
        short = [dict(x, after_reliable=x["after_reliable"] and k == 4) for k, x in enumerate(steps)]
        beam = sorted(wide, key=lambda p: cost(short[: i + 1], grid, signal, p))[:4]
    assert [r.cand for r in got] == beam[0]


def brute_runs(p, tol):
    moved = {i: (x, y) for i, (x, y, _, _) in enumerate(p)}
    ang = lambda i, j: math.atan2(p[j][1] - p[i][1], p[j][0] - p[i][0])
    runs, start, line = [], None, 0.0
    for i in range(1, len(p)):
        if p[i][2]:
            if start is None:
                start, line = i - 1, ang(i - 1, i)
            elif turn(line - ang(i - 1, i)) <= tol:
                line = ang(start, i)
            else:
                runs.append((start, i - 1))
                start, line = i - 1, ang(i - 1, i)
        elif start is not None:
            runs.append((start, i if turn(ang(start, i) - ang(i - 1, i)) <= tol else i - 1))
            start = None
    for a, b in runs:
        if b - a > 1:
            total = sum(p[k][3] for k in range(a + 1, b + 1))
            for k in range(a + 1, b):
                share = sum(p[j][3] for j in range(a + 1, k + 1)) / total
                moved[k] = (p[a][0] + (p[b][0] - p[a][0]) * share, p[a][1] + (p[b][1] - p[a][1]) * share)
    return moved


def test_redistribute(spark):
    rng = np.random.default_rng(13)
    made = {}
    for t in range(40):
        at, out, d = np.zeros(2), [], np.array([2.0, 0.0])
        for _ in range(int(rng.integers(1, 12))):
            if rng.random() < 0.3:
                d = rng.choice([[2.0, 0.0], [0.0, 2.0], [1.0, 1.0]])
            at = at + d
            out.append((float(at[0]), float(at[1]), bool(rng.random() < 0.6), float(rng.uniform(1, 5))))
        made[t] = out
    df = spark.createDataFrame([(t, i, *p) for t, ps in made.items() for i, p in enumerate(ps)], "t long, i int, x double, y double, off boolean, len double")
    got = O.redistribute(df, ["t"], "i", "off", "len").collect()
    assert len(got) == sum(map(len, made.values())) and any(r.moved for r in got)
    want = {t: brute_runs(p, 0.05) for t, p in made.items()}
    for r in got:
        assert (r.x, r.y) == pytest.approx(want[r.t][r.i], abs=1e-9)
        assert r.moved == (want[r.t][r.i] != made[r.t][r.i][:2] and r.moved)


def test_search_of_floors_is_that_of_rows(spark):
    """The same paths whether a trail's candidates come as rows or with its floor, which many trails share."""
    rng = np.random.default_rng(13)
    grids = {f: [(f, c, *map(float, rng.integers(0, 20, 2)), float(c % 3), float(c % 2)) for c in range(4 + 5 * f)] for f in range(3)}
    rows = []
    for t in range(14):
        steps, *_ = make(rng, 1 + t % 5, 2, t)
        rows += [(t % 3, t, i, *[float(v) if not isinstance(v, bool) else v for v in (s[c] for c in O.STEP[1:])]) for i, s in enumerate(steps)]
    kinds = ", ".join(f"{c} {'boolean' if 'reliable' in c else 'double'}" for c in O.STEP[1:])
    # Floor 3 has a trail and no candidates.
    steps = spark.createDataFrame([*rows, (3, 99, 0, *rows[0][3:])], f"floor int, trail long, step int, {kinds}")
    grid = spark.createDataFrame([r for g in grids.values() for r in g], "floor int, cand int, x double, y double, off_grid double, dense double")
    cells = steps.select("floor", "trail", "step", "wx", "wy").join(grid, "floor").withColumn("signal", F.sqrt((F.col("x") - F.col("wx")) ** 2 + (F.col("y") - F.col("wy")) ** 2))
    signal = lambda s, c: np.hypot(c["x"] - s["wx"][:, None], c["y"] - s["wy"][:, None])
    at = lambda df: sorted((r.trail, r.step, r.cand, *(round(r[p], 6) for p in (*O.PENALTIES, "total"))) for r in df.collect())
    want = at(O.search_paths(steps, cells, ["trail"], width=6, by_signal=2, by_move=3))
    assert at(O.search_floors(steps, grid, ["floor"], ["trail"], signal, width=6, by_signal=2, by_move=3, trails_per_task=2)) == want
    assert len(want) == len(rows)
