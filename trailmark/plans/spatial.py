"""Registered queries on points, fingerprints and order-dependent groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import fingerprint as P
from ..operators import geometry as G
from ..operators import stateful as Z
from ..operators import stats as S
from ..operators import vectors as V
from ..sources.sinks import cut
from .series import EV, R, events, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def points(spark, d):
    """Parts as points of a floor (the brand): size by the price's last digits."""
    return read(spark, d, "part").select(F.col("p_brand").alias("floor"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"))


PT = "p AS (SELECT p_brand AS floor, p_partkey AS id, p_size::DOUBLE AS x, p_retailprice - 900 AS y FROM part)"


@query(f"WITH {PT}, q AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS r FROM p a JOIN p b ON a.floor = b.floor AND a.id <> b.id) SELECT id, r AS rank, round(d, 6) AS distance FROM q WHERE r <= 3")
def knn_spatial(spark, d):
    p = points(spark, d)
    o = p.select("floor", F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return G.knn(p, o, ["floor"], "id", "other", 3).select("id", F.col("rank").cast("bigint").alias("rank"), R("distance").alias("distance"))


@query(f"WITH {PT}, s AS (SELECT a.id, sum(1 / greatest(1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))) AS v FROM p a JOIN p b ON a.floor = b.floor AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 5 GROUP BY a.id) SELECT p.id, round(coalesce(v, 0), 6) AS density FROM p LEFT JOIN s USING (id)")
def density_inverse(spark, d):
    return G.crowd(points(spark, d), ["floor"], 5.0).select("id", R(F.coalesce("v", F.lit(0.0))).alias("density"))


EM = "e AS (SELECT vec_id, label, embedding FROM embeddings), pr AS (SELECT q.vec_id, q.label, r.vec_id AS other, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM e q JOIN e r ON {on} AND q.vec_id <> r.vec_id WHERE q.vec_id % 5 = 0)"


def _vectors(spark, d):
    """A stated query set and all rows, and whether a vector is as usual: of the greatest length, all components there and finite."""
    e = read(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    usual = F.coalesce((F.size("embedding") == F.lit(size)) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    e = e.withColumn("usual", usual)
    q = e.where("vec_id % 5 = 0").select("vec_id", "label", F.col("embedding").alias("a"), "usual")
    return q, e.select(F.col("vec_id").alias("other"), F.col("label").alias("other_label"), F.col("embedding").alias("b"), "usual")


def _odd_pairs(q, r, same_label: bool):
    """Pairs with a vector that is not as usual, by expressions; few or none."""
    on = [F.col("vec_id") != F.col("other")] + ([F.col("label") == F.col("other_label")] if same_label else [])
    all_q, all_r = q.withColumnRenamed("usual", "usual_q"), r.withColumnRenamed("usual", "usual_r")
    pairs = all_q.where("not usual_q").join(all_r, on).unionByName(all_q.where("usual_q").join(all_r.where("not usual_r"), on))
    return pairs.drop("usual_q", "usual_r").withColumn("d", X.vector_l1(F.col("a"), F.col("b")))


@query("WITH " + EM.format(on="q.label = r.label") + ", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r, min(d) OVER (PARTITION BY vec_id) AS lo FROM pr QUALIFY r <= 20) SELECT vec_id, round(sum(((d + 1e-5) / (lo + 1e-5)) ** -4 * other) / sum(((d + 1e-5) / (lo + 1e-5)) ** -4), 3) AS position FROM k GROUP BY vec_id")
def knn_embedding_top20(spark, d):
    q, r = _vectors(spark, d)
    near = V.nearest_of_label(q.where("usual and label is not null").drop("usual"), r.where("usual and other_label is not null").drop("usual"), 20)
    pairs = near.unionByName(_odd_pairs(q, r, True).select("vec_id", "other", "d")).withColumn("position", F.col("other").cast("double"))
    return S.power_mean_of_nearest(pairs, ["vec_id"], "d", ["position"], [F.col("d"), F.col("other")]).select("vec_id", R("position", 3).alias("position"))


@query(
    "WITH e AS (SELECT vec_id, label, embedding FROM embeddings), pr AS (SELECT q.vec_id, r.label AS floor, min(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 5 = 0 GROUP BY 1, 2), t AS (SELECT vec_id // 50 AS trail, floor, avg(d) AS s FROM pr GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY trail ORDER BY s, floor) AS r FROM t) SELECT trail, max(floor) FILTER (r = 1) AS best, round(max(s) FILTER (r = 1), 6) AS best_score, max(floor) FILTER (r = 2) AS second, round(max(s) FILTER (r = 2) - max(s) FILTER (r = 1), 6) AS gap_2, round(max(s) FILTER (r = 3) - max(s) FILTER (r = 1), 6) AS gap_3 FROM k GROUP BY trail"
)
def floor_by_mean_min(spark, d):
    q, r = _vectors(spark, d)
    near = V.least_by_label(q.where("usual").select("vec_id", "a"), r.where("usual and other_label is not null").drop("usual"))
    # Rows without a label and odd vectors meet by expressions.
    r = r.withColumn("usual", F.col("usual") & F.col("other_label").isNotNull())
    low = near.unionByName(_odd_pairs(q, r, False).select("vec_id", "other_label", "d")).groupBy("vec_id", F.col("other_label").alias("floor")).agg(F.min("d").alias("d"))
    t = low.groupBy(F.floor(F.col("vec_id") / 50).alias("trail"), "floor").agg(F.avg("d").alias("s"))
    g = S.best_gaps(t, ["trail"], "s", "floor")
    return g.withColumns({c: R(c) for c in ("best_score", "gap_2", "gap_3")})


FP = f"""WITH {EV}, b AS (SELECT user_id % 5 AS site, user_id, t, k, -(value % 90) - 1 AS rssi, (event_id % 7) * 500 AS delay, event_id, event_type FROM e),
m0 AS (SELECT site, user_id // 5 AS pos, k, rssi AS rm, delay AS dm FROM b WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY site, user_id // 5, k ORDER BY t DESC, event_id DESC) = 1),
nt AS (SELECT site, k, count(DISTINCT user_id) AS n_trails FROM b WHERE event_type <> 'view' GROUP BY site, k),
m AS (SELECT m0.*, n_trails FROM m0 JOIN nt USING (site, k)),
q AS (SELECT site, user_id AS fn, t // 86400000000 AS day, k, rssi AS rq, delay AS dq FROM b WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM m WHERE m.site = b.site AND m.k = b.k)),
sh AS (SELECT q.site, fn, day, pos, sum((1.0 / n_trails) ** 0.2 * 0.92 ** ((greatest(1000, dq) - 1000) / 1000.0) * 0.92 ** ((greatest(1000, dm) - 1000) / 1000.0) * abs(rm - rq)) AS num,
  sum((1.0 / n_trails) ** 0.2 * 0.92 ** ((greatest(1000, dq) - 1000) / 1000.0) * 0.92 ** ((greatest(1000, dm) - 1000) / 1000.0)) AS den,
  sum((rm + 100) * 0.8 ** ((greatest(1000, dm) - 1000) / 1000.0)) AS sr, sum((rq + 100) * 0.8 ** ((greatest(1000, dq) - 1000) / 1000.0)) AS si FROM q JOIN m USING (site, k) GROUP BY ALL),
tq AS (SELECT site, fn, day, sum((rq + 100) * 0.8 ** ((greatest(1000, dq) - 1000) / 1000.0)) AS it FROM q GROUP BY ALL),
tm AS (SELECT site, pos, sum((rm + 100) * 0.8 ** ((greatest(1000, dm) - 1000) / 1000.0)) AS rt FROM m GROUP BY ALL),
x AS (SELECT site, fn, day, pos, coalesce(num, 0) / (coalesce(den, 0) + 1e-9) AS dd, (coalesce(sr, 0) + it) / (coalesce(sr, 0) + it + (it - coalesce(si, 0)) + (rt - coalesce(sr, 0))) AS f FROM tq JOIN tm USING (site) LEFT JOIN sh USING (site, fn, day, pos)),
dist AS (SELECT site, fn, day, pos, dd + 50 * greatest(0, 1 - f) ** 2 AS distance FROM x)"""


def _fingerprint(spark, d):
    b = events(spark, d).select((F.col("user_id") % 5).alias("site"), F.col("user_id").alias("trail"), "t", F.col("k").alias("emitter"), (-(F.col("value") % 90) - 1).alias("rssi"), ((F.col("event_id") % 7) * 500).alias("delay"), "event_id", "event_type")
    ref = b.where("event_type <> 'view'").withColumn("pos", F.floor(F.col("trail") / 5))
    model = P.fit(ref, ["site"], [F.desc("t"), F.desc("event_id")]).select("site", "pos", "emitter", "rssi", "delay", "n_trails")
    scans = b.where("event_type = 'view'").withColumns({"fn": F.col("trail"), "day": F.floor(F.col("t") / 86_400_000_000)})
    return P.known_only(scans, model, ["site"]), model, scans


@query(FP + " SELECT site, fn, day, pos, round(distance, 5) AS distance FROM dist")
def sparse_fingerprint_distance(spark, d):
    q, m, _ = _fingerprint(spark, d)
    return P.distances(q, m, ["site"], ["fn", "day"]).select("site", "fn", "day", "pos", R("distance", 5).alias("distance"))


@query(FP + ", best AS (SELECT site, fn, day, pos, distance FROM dist QUALIFY row_number() OVER (PARTITION BY site, fn, day ORDER BY distance, pos) = 1), s AS (SELECT DISTINCT user_id % 5 AS site, user_id AS fn, t // 86400000000 AS day FROM sc) SELECT site, fn, day, coalesce(pos, 0) AS pos, round(coalesce(distance, 999), 5) AS distance FROM s LEFT JOIN best USING (site, fn, day)")
def triangulate_top1(spark, d):
    q, m, scans = _fingerprint(spark, d)
    return P.nearest_position(scans, q, m, ["site"], ["fn", "day"]).withColumn("distance", R("distance", 5))


@query(FP + ", nq AS (SELECT site, fn, day, count(*) AS nq FROM q GROUP BY ALL), nm AS (SELECT site, pos, count(*) AS nm FROM m GROUP BY ALL), bo AS (SELECT q.site, fn, day, pos, avg(least(30, abs(rq - rm))) AS d, count(*) AS n FROM q JOIN m USING (site, k) GROUP BY ALL) SELECT site, fn, day, pos, round(coalesce(d, 30) + (0.8 - least(0.8, coalesce(n, 0) / greatest(20, least(nq, nm))::DOUBLE)) * 40, 5) AS distance FROM nq JOIN nm USING (site) LEFT JOIN bo USING (site, fn, day, pos)")
def fingerprint_distance_capped(spark, d):
    q, m, _ = _fingerprint(spark, d)
    return P.distances_capped(q, m, ["site"], ["fn", "day"]).withColumn("distance", R("distance", 5))


@query(FP + ", nq AS (SELECT site, fn, day, count(*) AS nq FROM q GROUP BY ALL), nm AS (SELECT site, pos, count(*) AS nm FROM m GROUP BY ALL), bo AS (SELECT q.site, fn, day, pos, sum((rq - rm) ** 2 / 100) AS d, count(*) AS n FROM q JOIN m USING (site, k) GROUP BY ALL) SELECT site, fn, day, pos, round((coalesce(d, 0) + nq + nm - 2 * coalesce(n, 0)) / (nq + nm - coalesce(n, 0)) + 1e-9, 7) AS distance FROM nq JOIN nm USING (site) LEFT JOIN bo USING (site, fn, day, pos)")
def fingerprint_distance_squared(spark, d):
    q, m, _ = _fingerprint(spark, d)
    return P.distances_squared(q, m, ["site"], ["fn", "day"]).withColumn("distance", R(F.col("distance") + 1e-9, 7))


@query(f"WITH {PT} SELECT id, round(x / 10) * 10 AS gx, floor(y / 10 + 0.5) * 10 AS gy FROM p")
def snap_to_grid(spark, d):
    return points(spark, d).select("id", (F.round(F.col("x") / 10) * 10).alias("gx"), (F.floor(F.col("y") / 10 + 0.5) * 10).cast("double").alias("gy"))


@query(f"WITH {PT} SELECT floor, floor(x / 10)::BIGINT AS bx, floor(y / 20)::BIGINT AS by, count(*) AS n, round(avg(y), 6) AS mean FROM p GROUP BY 1, 2, 3")
def binned_mean_2d(spark, d):
    return points(spark, d).groupBy("floor", F.floor(F.col("x") / 10).alias("bx"), F.floor(F.col("y") / 20).alias("by")).agg(F.count(F.lit(1)).alias("n"), R(F.avg("y")).alias("mean"))


WALL = f"""WITH {PT}, s AS (SELECT floor, id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY floor ORDER BY id)), mv AS (SELECT * FROM s WHERE x1 IS NOT NULL AND id % 2 = 0), wl AS (SELECT floor, id AS wall, x0 AS u0, y0 AS v0, x1 AS u1, y1 AS v1 FROM s WHERE x1 IS NOT NULL AND id % 2 = 1),
c AS (SELECT id, count(*) AS n FROM mv JOIN wl ON mv.floor = wl.floor AND ((x1 - x0) * (v0 - y0) - (y1 - y0) * (u0 - x0)) * ((x1 - x0) * (v1 - y0) - (y1 - y0) * (u1 - x0)) < 0 AND ((u1 - u0) * (y0 - v0) - (v1 - v0) * (x0 - u0)) * ((u1 - u0) * (y1 - v0) - (v1 - v0) * (x1 - u0)) < 0 GROUP BY id)"""


@query(WALL + " SELECT mv.id, coalesce(n, 0) AS crossings FROM mv LEFT JOIN c USING (id)")
def wall_crossings(spark, d):
    w = Window.partitionBy("floor").orderBy("id")
    # Written once, as moves are read twice and walls once.
    s = cut(points(spark, d).select("floor", "id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null"))
    walls = s.where("id % 2 = 1").select("floor", F.col("id").alias("wall"), F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))
    return G.crossing_counts(s.where("id % 2 = 0"), walls, ["floor"], "id", 20.0).select("id", "crossings")


@query(f"WITH {PT}, b AS (SELECT floor, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY floor), gx AS (SELECT floor, y0, y1, unnest(range(ceil(x0 / 7)::BIGINT, floor(x1 / 7)::BIGINT + 1)) * 7.0 AS x FROM b), g AS (SELECT floor, x, unnest(range(ceil(y0 / 7)::BIGINT, floor(y1 / 7)::BIGINT + 1)) * 7.0 AS y FROM gx) SELECT floor, x::DOUBLE AS x, y::DOUBLE AS y, (x + y < 70) AND (y - x < 40) AND (x - y < 30) AND (x + y > 10) AS inside FROM g WHERE abs(x + y - 70) > 0.01 AND abs(y - x - 40) > 0.01 AND abs(x - y - 30) > 0.01 AND abs(x + y - 10) > 0.01")
def grid_inside_polygon(spark, d):
    box = points(spark, d).groupBy("floor").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    g = G.regular_grid(box, ["floor"], 7.0)
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((20, -10), (50, 20), (15, 55), (-15, 25))])
    x, y = F.col("x"), F.col("y")
    off = (F.abs(x + y - 70) > 0.01) & (F.abs(y - x - 40) > 0.01) & (F.abs(x - y - 30) > 0.01) & (F.abs(x + y - 10) > 0.01)
    return g.where(off).withColumn("inside", G.inside(x, y, ring))


@query(f"WITH {PT}, n AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS r, a.floor FROM p a JOIN p b ON a.floor = b.floor AND a.id <> b.id) SELECT floor, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(median(d), 6) AS median FROM n WHERE r = 2 AND d > 1.2 AND d < 20 GROUP BY floor")
def neighbour_distance_stats(spark, d):
    p = points(spark, d)
    o = p.select("floor", F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    k = G.knn(p, o, ["floor"], "id", "other", 2).where("rank = 2 and distance > 1.2 and distance < 20")
    return k.groupBy("floor").agg(R(F.avg("distance")).alias("mean"), R(F.stddev_pop("distance")).alias("std"), R(F.median("distance")).alias("median"))


def _site_orders(spark, d):
    """All orders with their site: the nation and a block of 1000 customers, so a site does not grow with the table."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = read(spark, d, "orders").join(c, "o_custkey", "left")
    return o.withColumn("site", F.concat_ws("_", "c_nationkey", F.floor(F.col("o_custkey") / 1000)))


@query()
def device_matching(spark, d):
    """Customers' orders as trajectories of their site, told apart by offsets made from the price."""
    sig = lambda k: F.array(*[F.round((F.col("o_custkey") % 7) * (i + 1) + (F.col("o_orderkey") % k) / 100.0, 3) for i in range(6)])
    t = _site_orders(spark, d).select("site", F.col("o_orderkey").alias("trail"), X.millis(F.col("o_orderdate")).alias("time"), sig(3).alias("first"), sig(2).alias("last"))
    return Z.match_devices(t, ["site"])


@query()
def chain_stitching(spark, d):
    t = X.millis(F.col("o_orderdate"))
    return Z.stitch_chains(_site_orders(spark, d).select("site", F.col("o_orderkey").alias("device"), t.alias("start"), (t + 3_600_000).alias("end"), F.lit(20.0).alias("step")), ["site"])


@query()
def greedy_holdout(spark, d):
    """Orders as trajectories, their suppliers as anchors; ten floors to a block of 10,000 order keys, so a floor does not grow with the table."""
    floor = F.floor(F.col("l_orderkey") / 10_000) * 10 + F.col("l_orderkey") % 10
    li = read(spark, d, "lineitem").select(floor.alias("floor"), F.col("l_orderkey").alias("trail"), F.col("l_suppkey").alias("anchor"), X.hash_unit(F.col("l_orderkey"), "h").alias("u"))
    return Z.greedy_holdout(li, ["floor"])


@query()
def point_fusing(spark, d):
    return Z.fuse_points(points(spark, d), ["floor"], 6.0)


@query()
def point_fusing_local(spark, d):
    """Parts of a brand in a block of 2000 keys fused in two levels, the last digit of their key being the gap known for two thirds of them."""
    floor = F.concat_ws("_", "floor", F.floor(F.col("id") / 2000))
    gap = F.when(F.col("id") % 3 != 0, 1.0 + F.col("id") % 10)
    return Z.fuse_points_local(points(spark, d).select(floor.alias("floor"), "id", "x", (F.col("y") / 10).alias("y"), gap.alias("gap")), ["floor"], 8.0, 2.5)


@query()
def smoothing_solve(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, d, "orders").withColumns({"pos": F.row_number().over(w), "value": F.col("o_totalprice") / 1000, "step": F.lit(1.0)})
    return Z.smooth(o.select("o_custkey", "pos", "value", "step"), ["o_custkey"], "pos", "value", "step", 2.0)


@query()
def beam_search(spark, d):
    """Each user's purchases as steps: one candidate for each of ten emitters, its cost the distance from the reading's."""
    w = Window.partitionBy("user_id").orderBy("t")
    e = events(spark, d, "purchase").select("user_id", (F.row_number().over(w) - 1).cast("int").alias("step"), F.col("k").alias("k"))
    c = e.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(10)))).withColumns({"x": F.col("cand").cast("double"), "y": (F.col("cand") % 30).cast("double"), "cost": F.abs(F.col("cand") - F.col("k")).cast("double"), "dx": F.lit(5.0), "dy": F.lit(0.0)})
    return Z.beam_search(c.drop("k"), ["user_id"], 100)
