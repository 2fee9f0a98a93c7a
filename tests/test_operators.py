"""Operators against small cases worked out by hand or brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import exprs as X
from trailmark.operators import asof, band, ensemble, fingerprint, geometry, stateful, stats, timeline
from trailmark.sources import logs, sinks


def test_interpolate_clamps_and_hits_anchors(spark):
    a = spark.createDataFrame([("f", 1000, 0.0), ("f", 2000, 10.0), ("f", 4000, 30.0)], "fn string, t long, x double")
    s = spark.createDataFrame([("f", t) for t in (500, 1000, 1500, 2000, 3000, 5000)], "fn string, s long")
    got = asof.interpolate(s, a, ["fn"], "s", "t", ["x"]).orderBy("s")
    assert [r.x_at for r in got.collect()] == [0, 0, 5, 10, 20, 30]


def test_asof_first_scan_when_none_before(spark):
    s = spark.createDataFrame([("f", 10), ("f", 20)], "fn string, s long")
    a = spark.createDataFrame([("f", t) for t in (5, 10, 19, 25)], "fn string, a long")
    assert [r.s for r in asof.asof(a, s, ["fn"], "a", "s", ["s"]).orderBy("a").collect()] == [None, 10, 10, 20]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("slice_ms", [None, 7])
def test_asof_brute(spark, direction, strict, slice_ms):
    rng = np.random.default_rng(3)
    left = [(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 60), rng.integers(0, 60, 60), strict=True)]
    right = sorted({(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 25), rng.integers(0, 60, 25), strict=True)})
    got = asof.asof(spark.createDataFrame(left, "k int, t long"), spark.createDataFrame(right, "k int, u long"), ["k"], "t", "u", ["u"], direction, strict, slice_ms)
    back = direction == "backward"

    def best(k, t):
        ok = [u for j, u in right if j == k and (u < t or (u == t and not strict) if back else u > t or (u == t and not strict))]
        return (max(ok) if back else min(ok)) if ok else None

    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, t, best(k, t))) for k, t in left)


def test_segments_take_a_row_either_side(spark):
    r = spark.createDataFrame([("f", t) for t in (0, 20, 40, 60, 80)], "fn string, t long")
    a = spark.createDataFrame([("f", 30), ("f", 50)], "fn string, a long")
    got = band.interval_segments(r, a, ["fn"], "t", "a")
    assert sorted(x.t for x in got.collect()) == [20, 40, 60]


def test_strongest_near(spark):
    r = spark.createDataFrame([("f", "b", 0, -70), ("f", "b", 900, -50), ("f", "b", 2500, -60)], "fn string, bssid string, t long, rssi int")
    s = spark.createDataFrame([("f", 0), ("f", 900)], "fn string, s long")
    got = band.strongest_near(r, s, ["fn"], "bssid", "t", "s", "rssi", 1000, ["t"])
    assert {x.s: x.rssi for x in got.collect()} == {0: -50, 900: -50}


def test_robust_mean_and_angles(spark):
    d = spark.createDataFrame([(float(x),) for x in (18, 19, 20, 21, 40)], "d double")
    assert d.agg(stats.robust_mean(F.col("d"), 19, 21)).first()[0] == 20
    a = spark.createDataFrame([(3 * math.pi / 2,), (-3 * math.pi / 2,), (-math.pi,), (0.5,)], "a double")
    assert np.allclose([r[0] for r in a.select(X.wrap_angle(F.col("a"))).collect()], [-math.pi / 2, math.pi / 2, math.pi, 0.5])


def test_edge_similarity(spark):
    a = spark.createDataFrame([("A", "a", -50), ("A", "b", -60)], "key string, item string, rssi int")
    b = spark.createDataFrame([("B", "b", -64), ("B", "c", -70)], "key string, item string, rssi int")
    p = spark.createDataFrame([("A", "B"), ("A", "C")], "x string, y string")
    got = {r.y: (r.fraction, r["mean"]) for r in timeline.edge_similarity(a, b, p, "x", "y", "item", "rssi").collect()}
    assert got == {"B": (0.5, 4.0), "C": (-1.0, -1.0)}
    one = spark.range(1).select(timeline.dissimilarity(F.lit(0.5), F.lit(4.0), F.lit(40000))).first()[0]
    assert one == 11.0


def test_plan_choice(spark):
    d = spark.createDataFrame([(100.0, 95.0, 80.0)], "base double, a double, b double")
    got = ensemble.choose_plan(d, "base", ["a", "b"], [F.lit(False)] * 2, bias=0.11).first()
    assert np.allclose(got.ratios, [100 / 95, 100 / 80 - 0.11]) and got.plan == 2


def test_mode_takes_smallest_of_equals(spark):
    d = spark.createDataFrame([("g", x) for x in "baab"], "g string, v string")
    assert stats.mode_value(d, ["g"], "v").first().v == "a"


def test_unshared_position_has_a_distance(spark):
    q = spark.createDataFrame([(0, "s", 1, -50.0, 0)], "site int, scan string, emitter int, rssi double, delay long")
    m = spark.createDataFrame([(0, 7, 1, -55.0, 0, 1), (0, 8, 2, -40.0, 0, 1)], "site int, pos int, emitter int, rssi double, delay long, n_trails int")
    got = {r.pos: r.distance for r in fingerprint.distances(q, m, ["site"], ["scan"]).collect()}
    assert got[7] == pytest.approx(5.0, abs=1e-6)
    # Totals only: 50 * (1 - 50 / (50 + 50 + 60)) ** 2.
    assert got[8] == pytest.approx(50 * (1 - 50 / 160) ** 2)
    none = spark.createDataFrame([(0, "t")], "site int, scan string")
    far = fingerprint.triangulate(none, fingerprint.distances(q, m, ["site"], ["scan"]), ["site", "scan"]).first()
    assert (far.pos, far.distance) == (0, 999.0)


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    p = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 3.9)], "x double, y double")
    assert [r[0] for r in p.select(geometry.inside(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True]
    v = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(((0, 0), (2, 0), (4, 0), (4, 4), (0, 4)))], "f int, i int, x double, y double")
    assert sorted(r.i for r in geometry.corners(v, ["f"], "i", 5).collect()) == [0, 2, 3, 4]
    g = spark.createDataFrame([("a", 0.0, 0.0, 4.0, 0.0, 0.0, 2.0, 4.0, 2.0, 3, 2)], "f string, x00 double, y00 double, x01 double, y01 double, x10 double, y10 double, x11 double, y11 double, nr int, nc int")
    assert geometry.bilinear_grid(g, ["f"], "nr", "nc").count() == 6
    d = spark.range(1).select(geometry.point_to_segment(*[F.lit(float(x)) for x in (0, 3, -1, 0, 1, 0)])).first()[0]
    assert d == 3.0


def test_devices_follow_drifting_offsets(spark):
    z = lambda *v: [float(x) for x in v]
    rows = [("s", 1, 0, z(1, 2, 3, 4, 5, 6), z(1.1, 2, 3, 4, 5, 6)), ("s", 2, 1, z(9, 9, 9, 9, 9, 9), z(9, 9, 9, 9, 9, 9)), ("s", 3, 2, z(1.2, 2.1, 3.1, 4, 5, 6), z(1, 2, 3, 4, 5, 6)), ("s", 4, 3, None, None)]
    d = spark.createDataFrame(rows, "site string, trail int, time long, first array<double>, last array<double>")
    assert {r.trail: r.device for r in stateful.match_devices(d, ["site"]).collect()} == {1: 0, 2: 1, 3: 0, 4: -1}


def test_smoothing_solves_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    c, s = rng.normal(size=6), rng.normal(size=6)
    d = spark.createDataFrame([("k", i, float(c[i]), float(s[i])) for i in range(6)], "k string, i int, v double, s double")
    got = [r.smooth for r in stateful.smooth(d, ["k"], "i", "v", "s", 2.0).orderBy("i").collect()]
    diff = np.eye(6, k=1)[:5] - np.eye(6)[:5]
    want = np.linalg.solve(np.eye(6) + 2 * diff.T @ diff, c + 2 * diff.T @ s[:5])
    assert np.allclose(got, want)


def test_beam_finds_the_cheapest_way(spark):
    import itertools

    rng = np.random.default_rng(2)
    rows = [("k", t, c, float(rng.normal()), float(rng.normal()), float(rng.random()), 0.3, 0.1) for t in range(4) for c in range(4)]
    d = spark.createDataFrame(rows, "k string, step int, cand int, x double, y double, cost double, dx double, dy double")
    got = stateful.beam_search(d, ["k"], 400).orderBy("step").collect()
    by = {(r[1], r[2]): r for r in rows}

    def cost(way):
        total = by[0, way[0]][5]
        for t in range(1, 4):
            a, b = by[t - 1, way[t - 1]], by[t, way[t]]
            total += b[5] + math.hypot(b[3] - a[3] - 0.3, b[4] - a[4] - 0.1) + (1e6 if way[t] == way[t - 1] else 0)
        return total

    best = min(itertools.product(range(4), repeat=4), key=cost)
    assert tuple(r.cand for r in got) == best and got[0].total == pytest.approx(cost(best))


def test_fusing(spark):
    d = spark.createDataFrame([("f", 1, 0.0, 0.0), ("f", 2, 1.0, 0.0), ("f", 3, 9.0, 9.0)], "f string, id long, x double, y double")
    got = sorted((r.cluster, r.points, r.x) for r in stateful.fuse_points(d, ["f"], 2.0).collect())
    assert got == [(1, 2, 0.5), (3, 1, 9.0)]


def test_log_repair_and_summary(spark, tmp_path):
    text = "#\tstartTime:1560915938000\n1560915938818\tTYPE_WAYPOINT\t196.41\t117.84\n1560915938900\tTYPE_WIFI\ts\tb\t-44\t2447\t15609159381571560915938901\tTYPE_WAYPOINT\t1.0\t2.0\n\n1560915938999\tFOO\n"
    (tmp_path / "a.txt").write_text(text)
    lines = logs.read_lines(spark, str(tmp_path))
    rec = logs.repair(lines)
    assert [(r.ts, r.tag) for r in rec.where("tag is not null").orderBy("ts").collect()] == [(1560915938818, "TYPE_WAYPOINT"), (1560915938900, "TYPE_WIFI"), (1560915938901, "TYPE_WAYPOINT")]
    assert rec.where("corrupt is not null").count() == 1
    s = logs.file_summary(lines).first()
    assert (s.start_time, s.complete, s.num_waypoints, s.first_waypoint.x, s.last_waypoint.y) == (1560915938000, False, 2, 196.41, 2.0)
    t = logs.typed(rec, "TYPE_WAYPOINT", [("x", "double"), ("y", "double"), ("z", "double")])
    assert t.where("z is not null").count() == 0 and t.count() == 2


def test_sinks(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    p = str(tmp_path / "t")
    assert sinks.once(spark, p, build).count() == 3 and sinks.once(spark, p, build).count() == 3 and len(made) == 1
    t = spark.createDataFrame([(1, "s_f_0000000000009"), (2, "s_g_0000000000001")], "n int, key string")
    p = spark.createDataFrame([("s", "f", 9, 2, 1.5, 2.5)], "site string, path string, ts long, floor int, x double, y double")
    assert [(r.site_path_timestamp, r.floor) for r in sinks.submission(t, p).collect()] == [("s_f_0000000000009", 2), ("s_g_0000000000001", None)]


def test_geojson(spark):
    j = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},{"geometry":{"type":"Polygon","coordinates":[[[5,5],[6,5]]]}}]}'
    got = logs.floor_outline(spark.createDataFrame([("s", j)], "site string, json string"))
    assert got.where("part = 0").count() == 3 and got.where("part = 1").count() == 2


def test_holdout_and_chains(spark):
    rows = [("f", t, a, 0.9) for t in range(3) for a in range(8)] + [("f", 9, a, 0.9) for a in range(100, 108)]
    got = stateful.greedy_holdout(spark.createDataFrame(rows, "f string, trail int, anchor int, u double"), ["f"]).collect()
    assert {r.trail for r in got} == {0, 1}
    c = spark.createDataFrame([("s", 1, 0, 100, 20.0), ("s", 2, 200, 300, 20.01), ("s", 3, 250, 400, 20.0), ("s", 4, 10**9, 10**9 + 1, 20.0)], "s string, device int, start long, end long, step double")
    assert {r.device: r.chain for r in stateful.stitch_chains(c, ["s"]).collect()} == {1: 0, 2: 0, 3: 1, 4: 2}
