import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import models, penalties, walls


def test_candidates_lie_inside_and_apart(spark):
    ring = [(0, 0), (40, 0), (40, 10), (10, 10), (10, 30), (0, 30)]
    o = spark.createDataFrame([("f", i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "floor string, i int, x double, y double")
    k = spark.createDataFrame([("f", 5.0, 5.0)], "floor string, x double, y double")
    got = walls.generate(o, k, ["floor"]).toPandas()
    p = got[["x", "y"]].to_numpy()
    assert len(p) > 10 and walls.inside(p, np.array(ring, float)).all()
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) + 99 * np.eye(len(p))
    assert d.min() >= 3 and np.hypot(*(p - [5, 5]).T).min() >= 2
    none = walls.generate(o.where("false"), k, ["floor"])
    assert none.count() == 0


def test_emitter_is_found(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 30, (200, 2))
    rows = [("e", float(x), float(y), float(-40 - ((x - 12) ** 2 + (y - 17) ** 2) / 20)) for x, y in xy]
    got = models.fit_emitters(spark.createDataFrame(rows, "e string, x double, y double, rssi double"), ["e"]).first()
    assert (got.x, got.y, got.power) == (pytest.approx(12, abs=0.1), pytest.approx(17, abs=0.1), pytest.approx(-40, abs=0.2))


def test_emitter_fit_takes_every_reading(spark):
    near = [("e", float(i % 30) / 10, float(i // 30) / 10, -40.0) for i in range(900)]
    far = [("e", 20.0, 20.0, -90.0)] * 8000
    got = models.fit_emitters(spark.createDataFrame(near + far, "e string, x double, y double, rssi double"), ["e"]).first()
    xy, s = (np.array([r[i:j] for r in near + far]).squeeze() for i, j in ((1, 3), (3, 4)))
    miss = np.abs(got.power - ((xy - [got.x, got.y]) ** 2).sum(1) / 20 - s).mean()
    assert got.n == 8900 and got.error == pytest.approx(miss) and got.error < 2


def test_boosting_out_of_fold(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 5).cast("int").alias("fold")).withColumn("y", F.col("a") * 2 + 1)
    got = models.out_of_fold(df, ["a"], "y", "fold", 2 + 3)
    assert got.count() == 400 and got.agg(F.avg(F.abs(F.col("y") - F.col("predicted")))).first()[0] < 8


def test_sections_and_signatures(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "k int, f double, m double, l double")
    got = {r.section: r.value for r in models.stack_sections(d, ["k"], {"f": "First", "m": "Middle", "l": "Last"}).collect()}
    assert got == {"First": 1.0, "Middle": 2.0, "Last": 3.0}
    q = spark.createDataFrame([("s", 1, 1.0, 5.0)], "s string, q int, a double, b double")
    r = spark.createDataFrame([("s", 7, 1.1, 5.2), ("s", 8, 3.0, 1.0), ("s", 9, 0.0, 9.0)], "s string, r int, a double, b double")
    assert models.nearest_signature(q, r, ["s"], "q", "r", ["a", "b"]).first().r == 7


def test_first_reliable_skips_seen_floors(spark):
    rows = [("k", 1, "F1", False), ("k", 2, "F1", True), ("k", 3, "F2", True), ("j", 1, "F1", False), ("j", 2, "F2", False)]
    d = spark.createDataFrame(rows, "k string, n int, floor string, ok boolean")
    got = {r.k: (r.n, r.tried, r.found) for r in penalties.first_reliable(d, ["k"], [F.col("n")], "floor", "ok").collect()}
    assert got == {"k": (3, 3, True), "j": (1, 2, False)}


def test_off_grid_penalty(spark):
    assert spark.range(1).select(penalties.off_grid(F.lit(False), F.lit(4.0))).first()[0] == pytest.approx(4.8)


def test_candidates_stand_as_known_points_do(spark):
    ring = np.array([(0, 0), (60, 0), (60, 24), (0, 24)], float)
    known = [(x, 1.5) for x in range(5, 56, 10)] + [(x, 22.5) for x in range(5, 56, 10)] + [(30.0, 12.0), (30.2, 12.1)]
    o = spark.createDataFrame([(f, i, *map(float, p)) for f in ("f", "g") for i, p in enumerate(ring)], "floor string, i int, x double, y double")
    k = spark.createDataFrame([("f", float(x), float(y)) for x, y in known] + [("h", 1.0, 1.0)], "floor string, x double, y double")
    got = walls.generate_from_known(o, k, ["floor"]).toPandas()
    assert set(got["floor"]) == {"f", "g"} and set(got["kind"]) == {"wall", "inner"}
    f = got[got["floor"] == "f"]
    p = f[["x", "y"]].to_numpy()
    assert walls.inside(p, ring).all()
    near = np.array([min(np.hypot(x - a, y - b) for a, b in known) for x, y in p])
    assert near.min() >= 2.8 and near.max() <= 30.2
    away, _, _ = walls.ring_places(f[f["kind"] == "wall"][["x", "y"]].to_numpy(), ring)
    # Along a long wall candidates stand as far off as the known ones.
    assert np.isclose(away, 1.5, atol=0.01).mean() > 0.6
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) + 99 * np.eye(len(p))
    assert d.min() > 1.0


def test_wall_habits_and_local_medians():
    ring = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    away, along, around = walls.ring_places(np.array([(2, 1), (9.5, 4), (5, 12), (0, 0)], float), ring)
    assert around == 40 and list(away) == [1, 0.5, 2, 0] and list(along) == [2, 14, 25, 0]
    v = walls.local_medians(np.array([1.0, 2.0, 9.0]), np.array([1.0, 3.0, 39.0]), 40.0, np.array([0.0, 20.0]), half=1, reach=5)
    assert list(v) == [5.0, 2.0]
    assert np.isnan(walls.local_medians(np.zeros(0), np.zeros(0), 4.0, np.array([1.0])))[0]
    h = walls.wall_habits(np.array([(1, 0.3), (4, 0.3), (7, 0.3), (5, 5)], float), ring)
    assert len(h["away"]) == 3 and h["usual"] == 3.0


def test_floor_rings_are_scaled_and_simple(spark):
    outer = [(10, 20), (15, 20.00001), (20, 20), (20, 30), (10, 30), (10, 20)]
    store = [(12, 22), (14, 22), (14, 24), (12, 24), (12, 22)]
    rows = [("f", k, 0, i, float(x), float(y)) for k, r in enumerate((outer, store)) for i, (x, y) in enumerate(r)] + [("g", 0, 0, 0, 1.0, 1.0)]
    o = spark.createDataFrame(rows, "floor string, part int, ring int, i int, x double, y double")
    got = walls.floor_rings(o, spark.createDataFrame([("f", 100.0, 50.0)], "floor string, width double, height double"), ["floor"]).collect()
    pts = {k: [(r.x, r.y) for r in sorted(got, key=lambda r: r.i) if r.part == k] for k in (0, 1)}
    assert pts[0] == [(0, 0), (100, 0), (100, 50), (0, 50)] and pts[1] == [(20, 10), (40, 10), (40, 20), (20, 20)]
    rng = np.random.default_rng(5)
    loop = np.stack((np.cos(np.arange(60) / 60 * 6.2), np.sin(np.arange(60) / 60 * 6.2)), axis=1) * 10 + rng.normal(0, 0.05, (60, 2))
    few = walls.simplified(loop, 0.4)
    assert 6 < len(few) < 40 and walls.ring_places(loop, few)[0].max() <= 0.4 + 1e-9
