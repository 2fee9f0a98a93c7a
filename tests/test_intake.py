"""Scans, sinks and small table operators on files and hand-made rows."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import fingerprint as P
from trailmark.operators import frames as K
from trailmark.operators import geometry as G
from trailmark.sources import sinks, tables


def test_csv_types_are_as_asked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,site,x\n1,007,1.5\n2,008,oops\n3,009,\n")
    df = tables.read_csv(spark, str(tmp_path), {"x": "double", "id": "bigint"})
    assert df.dtypes == [("id", "bigint"), ("site", "string"), ("x", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "007", 1.5), (2, "008", None), (3, "009", None)]
    assert tables.read_csv(spark, str(tmp_path), {"id": "int"}, where="site = '008'").count() == 1
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path), {"nope": "int"})


def test_first_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert tables.first_folder(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path)]) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        tables.first_folder(spark, [str(tmp_path / "a")])


def test_trails_by_path(spark):
    rows = [("file:/d/train/s1/F2/t1.txt", True), ("file:/d/train/s1/F2/t2.txt", False), ("file:/d/test/t3.txt", False), ("file:/d/other/x.txt", True)]
    got = tables.trails_by_path(spark.createDataFrame(rows, "file string, complete boolean"))
    assert {tuple(r)[2:] for r in got.collect()} == {("train", "s1", "F2", "t1"), ("train", "s1", "F2", "t2"), ("test", None, None, "t3"), (None, None, None, None)}
    assert {r.trail for r in tables.kept_trails(got).where("mode is not null").collect()} == {"t1", "t3"}


def test_feedback_blocks(spark):
    text = ["one.csv", "2 days ago", "", "a comment", "3.25", "", "two.csv", "1 day ago", "", "more", "Error", "", "three.csv", "now", "", "about x.csv", "1.5", "", "footer"]
    got = tables.feedback(spark.createDataFrame([("f", i, v) for i, v in enumerate(text)], "file string, i int, value string")).orderBy("n").collect()
    assert [tuple(r)[2:] for r in got] == [("one.csv", "2 days ago", "a comment", 3.25), ("three.csv", "now", "about x.csv", 1.5)]


def test_outlines_of_both_kinds(spark):
    sq = lambda o: [[o, o], [o + 1, o], [o + 1, o + 1], [o, o]]
    geo = {"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[sq(0), sq(5)], [sq(9)]]}}, {"geometry": {"type": "Polygon", "coordinates": [sq(3)]}}, {"geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    got = tables.outlines(spark.createDataFrame([("s", json.dumps(geo))], "site string, json string")).collect()
    assert len(got) == 16
    assert {(r.part, r.polygon, r.ring, r.x) for r in got if r.i == 0} == {(0, 0, 0, 0.0), (0, 0, 1, 5.0), (0, 1, 0, 9.0), (1, 0, 0, 3.0)}


def test_once_replaces_what_a_crash_left(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    os.makedirs(f"{path}/_temporary")
    assert sinks.once(spark, path, build).count() == 3 and sinks.once(spark, path, build).count() == 3 and len(built) == 1
    assert sinks.keyed(spark, str(tmp_path), "g", {"step": 1}, build).count() == 3
    sinks.keyed(spark, str(tmp_path), "g", {"step": 2}, build)
    sinks.keyed(spark, str(tmp_path), "g", {"step": 1}, build)
    assert len(built) == 3


def test_validated_cache(spark, tmp_path):
    path, built = str(tmp_path / "c"), []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)

        return run

    for n in (3, 3, 4, 4, 2):
        assert sinks.validated(spark, path, spark.range(n), "id", build(n)).count() == n
    assert built == [3, 4, 2]


def test_tree_log_and_purge(spark, tmp_path):
    df = spark.createDataFrame([("s", "F1", i % 3, float(i)) for i in range(9)], "site string, floor string, fn int, x double")
    sinks.tree(df, str(tmp_path / "tree"), ["site", "floor", "fn"], ["x"])
    assert sorted(os.listdir(tmp_path / "tree" / "site=s" / "floor=F1"))[:3] == ["fn=0", "fn=1", "fn=2"]
    for _ in range(2):
        sinks.log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 18
    df.write.partitionBy("fn").parquet(str(tmp_path / "part"))
    assert sinks.purge(spark, str(tmp_path / "part"), "fn >= 1") == 2
    assert spark.read.parquet(str(tmp_path / "part")).count() == 3


def test_active_range(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(30):
        own = sorted(int(x) for x in rng.integers(20, 60, 3))
        lo, hi, margin = 0, 99, 3
        low, high = max(lo, own[0] - margin), min(hi, own[-1] + margin)
        a, b = lo - 1, hi + 1
        for o in range(int(rng.integers(1, 5))):
            near = [int(x) for x in rng.integers(0, 100, int(rng.integers(0, 6)))]
            rows.append((k, o, near, own[0], own[-1], lo, hi))
            later, sooner = [t for t in near if high < t < b - 1], [t for t in near if a + 1 < t < low]
            b, a = (max(later) + 1 if later else b), (min(sooner) - 1 if sooner else a)
        want[k] = (a, b)
    df = spark.createDataFrame(rows, "k int, o int, near_times array<int>, own_min int, own_max int, all_min int, all_max int")
    assert {r.k: (r.active_from, r.active_to) for r in K.active_range(df, ["k"], "o", 3).collect()} == want


def test_stratified_draw_and_padding(spark):
    df = spark.createDataFrame([(g, i, 0.0 if i == 0 else 1.0 + i, (i * 37 % 101) / 101) for g, n in (("a", 50), ("b", 3), ("c", 1)) for i in range(n)], "g string, id int, w double, u double")
    got = K.stratified_draw(df, ["g"], "id", F.col("u"), F.col("w"), 0.08).where("drawn").groupBy("g").count()
    assert {r.g: r["count"] for r in got.collect()} == {"a": 4, "b": 1}
    pad = {r.g: list(r["values"]) for r in K.padded(df, ["g"], ["id"], "w", 4, -1.0).collect()}
    assert pad == {"a": [0.0, 2.0, 3.0, 4.0], "b": [0.0, 2.0, 3.0, -1.0], "c": [0.0, -1.0, -1.0, -1.0]}


def test_knn_by_cells_is_exact(spark):
    rng = np.random.default_rng(7)
    pts = [(f, f * 1000 + i, float(x), float(y)) for f, n in ((0, 120), (1, 3), (2, 1)) for i, (x, y) in enumerate(np.concatenate((rng.normal(0, 1, (n - n // 3, 2)), rng.uniform(-40, 40, (n // 3, 2)))).round(1))]
    pts += [(3, 3000 + i, 5.0, 5.0) for i in range(6)]
    df = spark.createDataFrame(pts, "floor int, id int, x double, y double")
    o = df.select("floor", F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    got = {(r.id, r.rank): r.other for r in G.knn(df, o, ["floor"], "id", "other", 3).collect()}
    want = {}
    for f, i, x, y in pts:
        near = sorted((np.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for g, j, a, b in pts if g == f and j != i)[:3]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(near)}
    assert got == want


def test_nearest_position_is_that_of_all_distances(spark):
    rng = np.random.default_rng(9)
    model = [(s, p, int(e), int(-rng.integers(30, 95)), int(rng.integers(0, 4000)), int(1 + e % 3)) for s in range(2) for p in range(12) for e in rng.choice(30, int(rng.integers(1, 5)), replace=False)]
    read = [(s, f, int(e), int(-rng.integers(30, 95)), int(rng.integers(0, 4000))) for s in range(3) for f in range(15) for e in rng.choice(40, int(rng.integers(1, 4)), replace=False)]
    m = spark.createDataFrame(model, "site int, pos int, emitter int, rssi int, delay int, n_trails int")
    scans = spark.createDataFrame(read, "site int, fn int, emitter int, rssi int, delay int")
    q = P.known_only(scans, m, ["site"])
    full = P.triangulate(scans, P.distances(q, m, ["site"], ["fn"]), ["site", "fn"])
    fast = P.nearest_position(scans, q, m, ["site"], ["fn"])
    key = lambda df: sorted((r.site, r.fn, r.pos, round(r.distance, 9)) for r in df.collect())
    assert key(full) == key(fast)
