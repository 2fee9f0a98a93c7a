"""Steps whose work must follow the places of the input: copies to cells are not broadcast, equal geometry meets once."""

import math

import numpy as np
from pyspark.sql import functions as F

from trailmark.operators import geometry as G
from trailmark.operators import outlines as O
from trailmark.operators import stateful as Z
from trailmark.plans import intake


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n, places):
    """``n`` points at ``places`` places of one floor."""
    i = F.col("id") % places
    return spark.range(n).select(F.lit("f").alias("floor"), "id", (i % 7).cast("double").alias("x"), F.floor(i / 7).cast("double").alias("y"))


def right(p):
    return p.select("floor", F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))


def test_knn_of_equal_points(spark):
    p = points(spark, 6000, 3)
    got = G.knn(p, right(p), ["floor"], "id", "other", 3)
    found = {}
    for r in got.collect():
        found.setdefault(r.id, []).append((r.rank, r.other, r.distance))
    assert len(found) == 6000
    assert sorted(found[0]) == [(1, 3, 0.0), (2, 6, 0.0), (3, 9, 0.0)]
    assert sorted(found[5999]) == [(1, 2, 0.0), (2, 5, 0.0), (3, 8, 0.0)]


def test_knn_crosses_places(spark):
    p = points(spark, 40, 20)
    rows = [tuple(r) for r in p.select("id", "x", "y").collect()]
    want = {(a, n + 1): o for a, x, y in rows for n, (_, o) in enumerate(sorted((math.hypot(x - u, y - v), o) for o, u, v in rows if o != a)[:3])}
    assert {(r.id, r["rank"]): r.other for r in G.knn(p, right(p), ["floor"], "id", "other", 3).collect()} == want


def test_near_pairs_not_broadcast(spark):
    p = points(spark, 20, 20)
    assert "Broadcast" not in plan(G.near_pairs(p, right(p), ["floor"], 2.0))


def test_crowd_of_equal_points(spark):
    got = {r.id: r.v for r in G.crowd(points(spark, 3000, 2), ["floor"], 5.0).collect()}
    assert len(got) == 3000 and {round(v, 6) for v in got.values()} == {2999.0}
    assert G.near_places(points(spark, 3000, 2), right(points(spark, 3000, 2)), ["floor"], 5.0).count() == 4


def test_crossings_of_equal_segments(spark):
    moves = spark.range(500).select(F.lit("f").alias("floor"), "id", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 4.0), ("y1", 4.0))])
    walls = spark.range(300).select(F.lit("f").alias("floor"), F.col("id").alias("wall"), *[F.lit(v).alias(c) for c, v in (("u0", 0.0), ("v0", 4.0), ("u1", 4.0), ("v1", 0.0))])
    got = G.crossing_counts(moves, walls, ["floor"], "id", 20.0)
    assert {r.crossings for r in got.collect()} == {300}


def test_crossings_shuffle_no_pair(spark):
    """Long segments of many common cells, left and right of nought: each pair counts once, and no exchange has both of its sides."""
    rng = np.random.default_rng(7)
    rows = [("f", i, *rng.integers(-30, 30, 4).astype(float).tolist()) for i in range(60)]
    moves = spark.createDataFrame(rows, "floor string, id long, x0 double, y0 double, x1 double, y1 double")
    walls = spark.createDataFrame([(f, i, *rng.integers(-30, 30, 4).astype(float).tolist()) for f, i, *_ in rows], "floor string, wall long, u0 double, v0 double, u1 double, v1 double")
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    crossed = lambda a, b, c, d: side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
    want = {r[1]: sum(crossed(r[2:4], r[4:], tuple(w)[2:4], tuple(w)[4:]) for w in walls.collect()) for r in rows}
    got = G.crossing_counts(moves, walls, ["floor"], "id", 4.0)
    assert {r.id: r.crossings for r in got.collect()} == want and max(want.values()) > 3
    assert not [x for x in plan(got).splitlines() if "Exchange" in x and "x0" in x and "u0" in x]


def test_fusing_equal_points(spark):
    p = points(spark, 4000, 4)
    got = Z.fuse_points(p, ["floor"], 0.5).collect()
    assert sorted((r.cluster, r.points) for r in got) == [(i, 1000) for i in range(4)]


def test_weights_stand_for_points():
    import numpy as np

    xy = np.array([[0.0, 0.0], [3.0, 0.0], [5.5, 0.0], [20.0, 0.0]])
    n = np.array([5, 1, 2, 1])
    whole = Z.average_linkage(np.repeat(xy, n, axis=0), 4.0)
    at = np.repeat(np.arange(4), n)
    assert sorted(sorted(set(at[m].tolist())) for m in whole) == sorted(sorted(m) for m in Z.average_linkage(xy, 4.0, n))


def test_opened_copies_no_cell(spark):
    cells = spark.range(40 * 30).select(F.lit("f").alias("floor"), (F.col("id") % 40).alias("cx"), F.floor(F.col("id") / 40).alias("cy")).where("not (cx = 9 and cy > 3) and not (cx between 20 and 21)")
    got = O.opened(cells, ["floor"], 0.5, 0.8, 1.3)
    assert "Generate" not in plan(got)
    want = O.dilated(O.eroded(cells, ["floor"], 1.6), ["floor"], 2.08).join(cells, ["floor", "cx", "cy"], "left_semi")
    assert {(r.cx, r.cy) for r in got.collect()} == {(r.cx, r.cy) for r in want.collect()}


def test_vectors_of_a_label_by_blocks(spark):
    import numpy as np

    from trailmark.operators import vectors as V

    xs = np.random.default_rng(1).integers(0, 4, (60, 3)).astype(float)
    e = spark.createDataFrame([(i, i % 4, x.tolist()) for i, x in enumerate(xs)], "vec_id long, label int, v array<double>")
    q = e.where("vec_id % 5 = 0").select("vec_id", "label", F.col("v").alias("a"))
    r = e.select(F.col("vec_id").alias("other"), F.col("label").alias("other_label"), F.col("v").alias("b"))
    away = lambda i, j: float(np.abs(xs[i] - xs[j]).sum())
    want = {i: sorted((away(i, j), j) for j in range(60) if j != i and j % 4 == i % 4)[:3] for i in range(0, 60, 5)}
    got = {}
    for n in V.nearest_of_label(q, r, 3).collect():
        got.setdefault(n.vec_id, []).append((n.d, n.other))
    assert {i: sorted(v)[:3] for i, v in got.items()} == want
    low = {(n.vec_id, n.other_label): n.d for n in V.least_by_label(q.drop("label"), r).collect()}
    assert low == {(i, c): min(away(i, j) for j in range(60) if j != i and j % 4 == c) for i in range(0, 60, 5) for c in range(4)}


def test_signatures_tie_to_the_least_id(spark):
    from trailmark.operators.models import nearest_signature

    q = spark.createDataFrame([("g", 0, 1.0), ("g", 3, 1.0)], "g string, id long, m double")
    r = spark.createDataFrame([("g", 1, 2.0 + 1e-14), ("g", 2, 2.0), ("g", 4, 9.0)], "g string, other long, m double")
    got = {n.id: n.other for n in nearest_signature(q, r, ["g"], "id", "other", ["m"]).collect()}
    assert got == {0: 1, 3: 1}


def test_signatures_find_their_match_whatever_order_sums_take(spark):
    """Values that differ in their last bits each time they are worked out, as means over shuffled rows do."""
    import random

    from trailmark.operators.models import nearest_signature

    shaken = F.udf(lambda v: v + random.random() * 1e-12, "double").asNondeterministic()
    w = spark.range(60).select(F.lit("g").alias("g"), "id", shaken(F.col("id") / 3.0).alias("m"))
    q, r = w.where("id % 3 = 0"), w.where("id % 3 != 0").withColumnRenamed("id", "other")
    got = {n.id: n.other for n in nearest_signature(q, r, ["g"], "id", "other", ["m"]).collect()}
    assert got == {i: max(i - 1, 1) for i in range(0, 60, 3)}


def test_ring_crossings_not_broadcast(spark):
    square = [(p, 0, i, x + p, y + p) for p in (0, 1) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    rings = spark.createDataFrame([("f", *r) for r in square], "floor string, part long, ring int, i int, x double, y double")
    got = O.ring_crossings(rings, ["floor"], 4.0)
    assert "Broadcast" not in plan(got)
    assert {(r.x, r.y) for r in got.collect()} == {(2.0, 1.0), (1.0, 2.0)}


def test_smoothing_takes_many_keys_at_once(spark):
    """Keys of one to seven rows, each against its own linear system; no call for a key."""
    rows = [(k, i, float((k * 7 + i * 3) % 11), float(i % 3)) for k in range(40) for i in range(1 + k % 7)]
    out = Z.smooth(spark.createDataFrame(rows, "k int, pos int, value double, step double"), ["k"], "pos", "value", "step", 2.0)
    assert "MapInArrow" in plan(out) and "FlatMapGroups" not in plan(out)
    got = {(r.k, r.pos): r.smooth for r in out.collect()}
    assert len(got) == len(rows)
    for k in range(40):
        v, s = (np.array([r[c] for r in rows if r[0] == k]) for c in (2, 3))
        d = np.diff(np.eye(len(v)), axis=0)
        want = np.linalg.solve(np.eye(len(v)) + 2 * d.T @ d, v + 2 * d.T @ s[:-1])
        assert np.allclose([got[k, i] for i in range(len(v))], want)


def test_devices_are_told_apart_by_plain_numbers(monkeypatch):
    """No array for each known device, and the same devices as by arrays."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 3, 6) / 2 + rng.choice([0, 5e-9, 2e-6]) for _ in range(200)] + [np.array([np.inf, 0, 1, 1, 0, 0]), np.array([np.nan] * 6)]
    known, n, want = [], 0, []
    for x in sets:
        hit = next((i for i, y in enumerate(known) if np.abs(x - y[1]).sum() <= 0.5 or (np.isclose(x, y[1]) & (x != 0)).sum() > 1), None)
        if np.isnan(x).any():
            want.append(-1)
            continue
        device = n if hit is None else known.pop(hit)[0]
        n += hit is None
        known.insert(0, (device, x))
        want.append(device)
    monkeypatch.setattr(np, "isclose", None)
    known, n, got = [], 0, []
    for t, x in enumerate(sets):
        device, n = Z.known_device(known, n, t, list(x), list(x), 0.5, 1.0, None)
        got.append(device)
    assert got == want


def test_groups_of_single_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    rows = [(i % 9, i % 31, i % 5) for i in range(700)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(intake, "GROUP_ROWS", 100)
    df = intake.max_of_groups(spark, str(tmp_path))
    groups = {}
    for s, o, p in rows:
        groups.setdefault((s, o), []).append(p)
    want = {(s, max(len(v) for (t, _), v in groups.items() if t == s), max(len(set(v)) for (t, _), v in groups.items() if t == s)) for s in range(9)}
    assert {tuple(r) for r in df.collect()} == want
    # Seven tasks of about 100 rows, and no aggregate of whole rows before.
    dealt = [x for x in plan(df).splitlines() if "hashpartitioning(l_suppkey" in x and "l_orderkey" in x]
    assert dealt and all("7), REPARTITION_BY_NUM" in x for x in dealt)
