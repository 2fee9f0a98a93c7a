"""Order-dependent and fitted operators against second implementations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import models, stateful


def brute_linkage(xy, threshold):
    clusters = [[i] for i in range(len(xy))]
    mean = lambda a, b: np.mean([np.hypot(*(xy[i] - xy[j])) for i in a for j in b])
    while len(clusters) > 1:
        (w, a, b) = min((mean(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(clusters), 2))
        if w >= threshold:
            break
        clusters[a] += clusters.pop(b)
    return sorted(sorted(c) for c in clusters)


def test_fused_points_are_average_linkage(spark):
    rng = np.random.default_rng(3)
    rows = [(f, f * 100 + i, *map(float, p)) for f, n in enumerate((1, 2, 40, 60)) for i, p in enumerate(rng.uniform(0, 25, (n, 2)))]
    got = stateful.fuse_points(spark.createDataFrame(rows, "f int, id int, x double, y double"), ["f"], 3.0).collect()
    for f in range(4):
        mine = [r for r in rows if r[0] == f]
        xy = np.array([r[2:] for r in mine])
        want = {(mine[c[0]][1], len(c)): xy[c].mean(0) for c in brute_linkage(xy, 3.0)}
        have = {(r.cluster, r.points): (r.x, r.y) for r in got if r.f == f}
        assert have.keys() == want.keys() and all(have[k] == pytest.approx(tuple(want[k])) for k in want)


def test_smoothing_is_the_linear_systems_solution(spark):
    rng = np.random.default_rng(4)
    data = {k: (rng.normal(0, 5, n), rng.normal(0, 1, n)) for k, n in enumerate((1, 2, 3, 17))}
    df = spark.createDataFrame([(k, i, float(v), float(s)) for k, (vs, ss) in data.items() for i, (v, s) in enumerate(zip(vs, ss, strict=True))], "k int, i int, v double, s double")
    got = {(r.k, r.i): r.smooth for r in stateful.smooth(df, ["k"], "i", "v", "s", 1.7).collect()}
    for k, (v, s) in data.items():
        n = len(v)
        d = np.eye(n)[1:] - np.eye(n)[:-1]
        x = np.linalg.solve(np.eye(n) + 1.7 * d.T @ d, v + 1.7 * d.T @ s[:-1])
        assert [got[k, i] for i in range(n)] == pytest.approx(list(x))


def test_wide_beam_is_enumeration(spark):
    rng = np.random.default_rng(5)
    rows, best = [], {}
    for k in range(6):
        steps = [[(float(x), float(y), float(c)) for x, y, c in rng.uniform(0, 9, (4, 3))] for _ in range(4)]
        move = rng.normal(0, 3, (4, 2))
        rows += [(k, i, c, *steps[i][c], *map(float, move[i])) for i in range(4) for c in range(4)]

        def cost(path):
            total = steps[0][path[0]][2]
            for i in range(1, 4):
                (x, y, c), (px, py, _) = steps[i][path[i]], steps[i - 1][path[i - 1]]
                total += c + np.hypot(x - px - move[i][0], y - py - move[i][1]) + 1e6 * (path[i] == path[i - 1])
            return total

        best[k] = min((cost(p), p) for p in itertools.product(range(4), repeat=4))
    df = spark.createDataFrame(rows, "k int, step int, cand int, x double, y double, cost double, dx double, dy double")
    got = stateful.beam_search(df, ["k"], 256).orderBy("k", "step").collect()
    for k in best:
        mine = [r for r in got if r.k == k]
        assert mine[0].total == pytest.approx(best[k][0]) and tuple(r.cand for r in mine) == best[k][1]


def test_emitters_tell_the_place(spark):
    rng = np.random.default_rng(6)
    at = rng.uniform(0, 40, (8, 2))
    emitters = spark.createDataFrame([("s", i, *map(float, p), -30.0, 1.0) for i, p in enumerate(at)], "site string, emitter int, x double, y double, power double, error double")
    spots = rng.uniform(5, 35, (10, 2))
    reads = [("s", k, i, float(-30 - ((p - q) ** 2).sum() / 20)) for k, p in enumerate(spots) for i, q in enumerate(at)] + [("s", 99, 77, -40.0)]
    got = {r.scan: (r.x, r.y, r.miss) for r in models.locate_by_emitters(spark.createDataFrame(reads, "site string, scan int, emitter int, rssi double"), emitters, ["site"], ["scan"]).collect()}
    assert got.keys() == set(range(10))
    right = sum(np.hypot(*(np.array(got[k][:2]) - spots[k])) < 0.5 for k in range(10))
    assert right >= 8


def test_speed_band_lowers_its_loss(spark):
    rng = np.random.default_rng(7)
    place = rng.uniform(0, 30, (40, 2))
    way = np.stack((np.linspace(5, 25, 5), np.full(5, 10.0)), axis=1)
    rows = [(1, int(i * 4000), p, *map(float, place[p]), float(np.hypot(*(place[p] - w)) + rng.uniform(0, 6))) for i, w in enumerate(way) for p in range(40)]
    rows += [(2, 0, p, *map(float, place[p]), float(p)) for p in range(40)]
    got = models.speed_band(spark.createDataFrame(rows, "t int, scan long, pos int, px double, py double, distance double"), ["t"]).orderBy("scan").collect()
    one = [r for r in got if r.t == 1]
    assert len(one) == 5 and one[0].loss < one[0].loss0
    gone = np.hypot(*np.diff([(r.x, r.y) for r in one], axis=0).T)
    gone0 = np.hypot(*np.diff([(r.x0, r.y0) for r in one], axis=0).T)
    band = lambda g: np.maximum(0, 2 * 4 / 3.6 - g).sum() + np.maximum(0, g - 6 * 4 / 3.6).sum()
    assert band(gone) <= band(gone0) + 1e-9
    assert sum(r.t == 2 for r in got) == 1


def test_scans_are_located_in_all_tasks(spark):
    """Searches of small rows are not gathered into one task."""
    reads = spark.createDataFrame([("s", k, e, -50.0 - k % 7 - e) for k in range(60) for e in range(3)], "site string, scan int, emitter int, rssi double")
    emitters = spark.createDataFrame([("s", e, 3.0 * e, 2.0, -40.0, 1.0) for e in range(3)], "site string, emitter int, x double, y double, power double, error double")
    got = models.locate_by_emitters(reads, emitters, ["site"], ["scan"])
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert got.count() == 60
