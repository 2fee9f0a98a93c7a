"""Registered queries on trajectory records: file summaries, hand grids, edges, enrichment, distance summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import asof as A
from ..operators import band as B
from ..operators import edges as E
from ..operators import fingerprint as P
from ..operators import geometry as G
from ..operators import locate as LO
from ..sources import logs, tables
from .series import EV, R, events, read
from .spatial import FP, _fingerprint

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH e AS (SELECT user_id AS u, epoch_us(ts) // 1000 AS ms, event_type AS k FROM events), s AS (SELECT u, min(ms) AS start_time, max(ms) + CASE WHEN u % 3 <> 0 THEN 5 ELSE 0 END AS end_time, u % 3 <> 0 AS complete, count(*) AS num_rows, count(*) FILTER (k = 'purchase') AS num_waypoints, count(*) FILTER (k = 'view') AS num_wifi, count(*) FILTER (k = 'click') AS num_beacon FROM e GROUP BY u)
SELECT 'u' || u AS trail, CASE WHEN u % 4 = 0 THEN 'test' ELSE 'train' END AS mode, CASE WHEN u % 4 <> 0 THEN 's' || (u % 5) END AS site, start_time, end_time, complete, num_rows, num_waypoints, num_wifi, num_beacon FROM s WHERE u % 4 = 0 OR complete"""
)
def file_summaries(spark, d):
    """Users' events as log files with header and, for two of three, footer; incomplete training files go."""
    e = events(spark, d).withColumn("ms", F.floor(F.col("t") / 1000))
    file = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("/data/test/u"), "user_id", F.lit(".txt"))).otherwise(F.concat(F.lit("/data/train/s"), F.col("user_id") % 5, F.lit("/F1/u"), "user_id", F.lit(".txt")))
    tag = F.when(F.col("event_type") == "purchase", "TYPE_WAYPOINT").when(F.col("event_type") == "view", "TYPE_WIFI").when(F.col("event_type") == "click", "TYPE_BEACON").otherwise("TYPE_ACCELEROMETER")
    rows = e.select(file.alias("file"), F.concat_ws("\t", "ms", tag, "value", F.coalesce("k", F.lit(0))).alias("value"))
    span = e.groupBy(file.alias("file"), "user_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    head = span.select("file", F.concat(F.lit("#\tstartTime:"), "a").alias("value"))
    foot = span.where("user_id % 3 != 0").select("file", F.concat(F.lit("#\tendTime:"), F.col("b") + 5).alias("value"))
    summary = logs.file_summary(rows.unionByName(head).unionByName(foot))
    return tables.kept_trails(tables.trails_by_path(summary)).select("trail", "mode", "site", "start_time", "end_time", "complete", "num_rows", "num_waypoints", "num_wifi", "num_beacon")


@query(
    """WITH c AS (SELECT n_nationkey AS f, n_nationkey * 1.0 AS a, 3 + n_nationkey % 3 AS rows_, 2 + n_nationkey % 2 AS cols FROM nation), g AS (SELECT *, unnest(range(rows_)) AS i FROM c), h AS (SELECT *, unnest(range(cols)) AS j FROM g),
u AS (SELECT *, i / (rows_ - 1.0) AS u, j / (cols - 1.0) AS v FROM h) SELECT f, i, j, round((1 - u) * ((1 - v) * a + v * (a + 10)) + u * ((1 - v) * (a + 1) + v * (a + 12)), 6) AS x, round((1 - u) * ((1 - v) * 0 + v * 2) + u * ((1 - v) * 8 + v * (9 + a)), 6) AS y FROM u"""
)
def hand_grids(spark, d):
    """Grids of points between four corners given by hand, one a nation."""
    a = F.col("n_nationkey").cast("double")
    at = {"x00": a, "x01": a + 10, "x10": a + 1, "x11": a + 12, "y00": F.lit(0.0), "y01": F.lit(2.0), "y10": F.lit(8.0), "y11": 9 + a}
    c = read(spark, d, "nation").select(F.col("n_nationkey").alias("f"), (3 + F.col("n_nationkey") % 3).cast("int").alias("nr"), (2 + F.col("n_nationkey") % 2).cast("int").alias("nc"), *[v.alias(k) for k, v in at.items()])
    g = G.bilinear_grid(c, ["f"], "nr", "nc")
    return g.select("f", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), R("x").alias("x"), R("y").alias("y"))


@query(
    FP
    + """, fq AS (SELECT *, 0.75 ** ((greatest(1000, dq) - 1000) / 1000.0) AS w FROM q), fm AS (SELECT *, 0.75 ** ((greatest(1000, dm) - 1000) / 1000.0) AS w FROM m),
aq AS (SELECT site, fn, day, sum((rq + 100) ** 2 / 100 * w) AS a FROM fq GROUP BY ALL), am AS (SELECT site, pos, sum((rm + 100) ** 2 / 100 * w) AS b FROM fm GROUP BY ALL),
bo AS (SELECT fq.site, fn, day, pos, sum((rq - rm) ** 2 / 100 * fq.w * fm.w - (rq + 100) ** 2 / 100 * fq.w - (rm + 100) ** 2 / 100 * fm.w) AS c FROM fq JOIN fm USING (site, k) GROUP BY ALL)
SELECT site, fn, day, pos, round(a + b + coalesce(c, 0) + 1e-9, 5) AS distance FROM aq JOIN am USING (site) LEFT JOIN bo USING (site, fn, day, pos)"""
)
def fingerprint_distance_faded(spark, d):
    """Squared differences of shared emitters and squared strengths of lone ones, all fading with delay; totals stand in for what is not shared."""
    q, m, _ = _fingerprint(spark, d)
    return P.distances_faded(q, m, ["site"], ["fn", "day"]).withColumn("distance", R(F.col("distance") + 1e-9, 5))


@query(FP + " SELECT site, fn, day, pos % 3 AS floor, count(*) AS n, round(min(distance), 5) AS least, round(quantile_cont(distance, 0.1), 5) AS p10, round(quantile_cont(distance, 0.5), 5) AS p50, round(quantile_cont(distance, 0.9), 5) AS p90, round(avg(distance), 5) AS mean FROM dist GROUP BY ALL")
def floor_distance_summary(spark, d):
    """Every scan on every floor of its site: least, deciles and mean of its distances."""
    q, m, _ = _fingerprint(spark, d)
    floors = m.select("site", "pos").distinct().withColumn("floor", F.col("pos") % 3)
    got = P.summaries(q, m, floors, ["site"], ["fn", "day"], "floor", [0.1, 0.5, 0.9])
    return got.select("site", "fn", "day", "floor", "n", *[R(c, 5).alias(n) for c, n in (("least", "least"), ("q0", "p10"), ("q1", "p50"), ("q2", "p90"), ("mean", "mean"))])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN abs(l_discount) > 0.02 THEN cos(l_discount) * l_quantity - sin(l_discount) * l_tax * 100 ELSE l_quantity END, 6) AS dx, round(CASE WHEN abs(l_discount) > 0.02 THEN sin(l_discount) * l_quantity + cos(l_discount) * l_tax * 100 ELSE l_tax * 100 END, 6) AS dy FROM lineitem")
def rotated_movements(spark, d):
    """Movements turned by their correction where it is large enough."""
    c, x, y = F.col("l_discount"), F.col("l_quantity"), F.col("l_tax") * 100
    big = F.abs(c) > 0.02
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R(F.when(big, F.cos(c) * x - F.sin(c) * y).otherwise(x)).alias("dx"), R(F.when(big, F.sin(c) * x + F.cos(c) * y).otherwise(y)).alias("dy"))


@query(
    f"""WITH {EV}, r AS (SELECT user_id % 5 AS site, user_id AS u, t // 86400000000 AS day, min(t) AS t0, max(t) AS t1, arg_min(value, struct_pack(t, event_id)) AS x0, arg_max(value, struct_pack(t, event_id)) AS x1, arg_min(k, struct_pack(t, event_id)) AS k0, arg_max(k, struct_pack(t, event_id)) AS k1 FROM e GROUP BY ALL),
s AS (SELECT *, lag(x1) OVER w AS px, (t0 - lag(t1) OVER w) / 1e6 AS pd, abs(k0 - lag(k1) OVER w) / 10.0 AS ps, lead(x0) OVER w AS sx, (lead(t0) OVER w - t1) / 1e6 AS sd, abs(lead(k0) OVER w - k1) / 10.0 AS ss FROM r WINDOW w AS (PARTITION BY site ORDER BY t0, u, day))
SELECT site, u, day, t0, t1, x0, x1, px AS preceding_x, round(pd, 3) AS delay_preceding, ps AS preceding_dissimilarity, coalesce(pd > 0 AND pd < 7200 AND ps < 5, false) AS reliable_preceding, sx AS succeeding_x, round(sd, 3) AS delay_succeeding, ss AS succeeding_dissimilarity, coalesce(sd > 0 AND sd < 7200 AND ss < 5, false) AS reliable_succeeding FROM s"""
)
def edge_records(spark, d):
    """Trajectories (a user's day) of a site in time order with where the one before ended and the one after began, and whether to rely on it."""
    first, last = F.struct("t", "event_id"), F.struct("t", "event_id")
    e = events(spark, d)
    r = e.groupBy((F.col("user_id") % 5).alias("site"), F.col("user_id").alias("u"), F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("value", first).alias("x0"), F.max_by("value", last).alias("x1"), F.min_by("k", first).alias("k0"), F.max_by("k", last).alias("k1")
    )
    w = Window.partitionBy("site").orderBy("t0", "u", "day")
    before, after = lambda c: F.lag(c).over(w), lambda c: F.lead(c).over(w)
    s = r.withColumns({"px": before("x1"), "pd": (F.col("t0") - before("t1")) / 1e6, "ps": F.abs(F.col("k0") - before("k1")) / 10.0, "sx": after("x0"), "sd": (after("t0") - F.col("t1")) / 1e6, "ss": F.abs(after("k0") - F.col("k1")) / 10.0})
    ok = lambda delay, gap: F.coalesce((F.col(delay) > 0) & (F.col(delay) < 7200) & (F.col(gap) < 5), F.lit(False))
    return s.select(
        "site", "u", "day", "t0", "t1", "x0", "x1",
        F.col("px").alias("preceding_x"), R("pd", 3).alias("delay_preceding"), F.col("ps").alias("preceding_dissimilarity"), ok("pd", "ps").alias("reliable_preceding"),
        F.col("sx").alias("succeeding_x"), R("sd", 3).alias("delay_succeeding"), F.col("ss").alias("succeeding_dissimilarity"), ok("sd", "ss").alias("reliable_succeeding"),
    )


@query("WITH k AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey * 1000 + l_linenumber) AS places FROM lineitem GROUP BY 1) SELECT l_suppkey, n, places, round(1 - places / n::DOUBLE, 6) AS repeats FROM k")
def repeat_ratio(spark, d):
    """Distinct places by one synthetic key and the share of rows that repeat one."""
    k = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("places"))
    return k.withColumn("repeats", R(1 - F.col("places") / F.col("n")))


@query(
    f"""WITH {EV}, s AS (SELECT user_id, t // 86400000000 AS day, list(value ORDER BY t, event_id) AS v FROM e GROUP BY ALL), n AS (SELECT *, lead(day) OVER w AS next_day, lead(v) OVER w AS nv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, len(v)::INTEGER AS first_rows, len(list_concat(v, nv))::INTEGER AS n_rows, round(list_sum(list_concat(v, nv)), 4) AS total, list_concat(v, nv)[len(v) + 1] AS seam FROM n WHERE next_day = day + 1"""
)
def concat_segments(spark, d):
    """Every segment (a user's day) joined with the one of the next day: overlapping pairs."""
    s = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))), lambda r: r["value"]).alias("v"))
    nxt = s.select("user_id", (F.col("day") - 1).alias("day"), F.col("v").alias("nv"))
    both = s.join(nxt, ["user_id", "day"]).withColumn("w", F.concat("v", "nv"))
    return both.select("user_id", "day", F.size("v").alias("first_rows"), F.size("w").alias("n_rows"), R(F.aggregate("w", F.lit(0.0), lambda a, b: a + b), 4).alias("total"), F.get("w", F.size("v")).alias("seam"))


@query("SELECT l_orderkey, arg_min(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_shipdate)) AS floor FROM lineitem GROUP BY 1")
def first_floors(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("floor"))


@query(
    """WITH dv AS (SELECT c_custkey AS o_custkey, c_nationkey % 7 AS device FROM customer WHERE c_acctbal > 0), fs AS (SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1), mt AS (SELECT o_orderkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax > 0.06 GROUP BY 1)
SELECT o_orderkey, o_custkey, coalesce(device, -1) AS device, coalesce(q, o_totalprice) AS time, first_key, last_key, round((coalesce(q, o_totalprice) - o_totalprice) / nullif(o_totalprice, 0), 6) AS relative_error FROM orders LEFT JOIN dv USING (o_custkey) LEFT JOIN mt USING (o_orderkey) JOIN fs USING (o_custkey)"""
)
def enriched_predictions(spark, d):
    """Predictions with their device, their segment's time or else the trajectory's, the trajectory's ends, and the relative error."""
    o = read(spark, d, "orders")
    dv = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 7).alias("device"))
    fs = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    mt = read(spark, d, "lineitem").where("l_tax > 0.06").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    time = F.coalesce("q", "o_totalprice")
    return o.join(dv, "o_custkey", "left").join(mt, "o_orderkey", "left").join(fs, "o_custkey").select("o_orderkey", "o_custkey", F.coalesce("device", F.lit(-1)).alias("device"), time.alias("time"), "first_key", "last_key", R(F.try_divide(time - F.col("o_totalprice"), F.col("o_totalprice"))).alias("relative_error"))


TRAILS = f"""{EV}, d AS (SELECT user_id % 5 AS site, user_id, t // 86400000000 AS day, t, event_id, event_type, value, k FROM e),
tr AS (SELECT site, user_id || '_' || day AS fn, CASE WHEN (user_id + day) % 7 = 0 THEN 'test' WHEN (user_id + day) % 7 = 1 THEN 'valid' ELSE 'train' END AS mode, min(t) // 1000 AS start_time, max(t) // 1000 AS end_time, user_id % 3 AS floor, count(*) AS num_waypoints,
  arg_min(value, (t, event_id)) AS first_x, arg_min(k, (t, event_id))::DOUBLE AS first_y, arg_max(value, (t, event_id)) AS last_x, arg_max(k, (t, event_id))::DOUBLE AS last_y, user_id % 4 AS device_id, CASE WHEN day % 5 = 0 THEN 'start' WHEN day % 5 = 1 THEN 'end' END AS leak FROM d GROUP BY site, user_id, day),
rd AS (SELECT site, user_id || '_' || day AS fn, t // 3600000000 AS scan, t // 1000 AS heard, k % 5 AS emitter, (-40 - value % 4) AS rssi FROM d WHERE k IS NOT NULL)"""


def _side_sql(side: str, before: bool) -> str:
    when = "o.end_time < a.start_time" if before else "o.start_time > a.end_time"
    order = "o.end_time DESC, o.fn" if before else "o.start_time, o.fn"
    x, y = ("last_x", "last_y") if before else ("first_x", "first_y")
    delay = "a.start_time - o.end_time" if before else "o.start_time - a.end_time"
    last, first = ("other", "fn") if before else ("fn", "other")
    return f"""{side}1 AS (SELECT a.site, a.fn, a.device_id AS own, o.fn AS other, {delay} AS delay, o.mode, o.floor, o.device_id, o.{x} AS x, o.{y} AS y, (o.mode <> 'test' OR coalesce(o.leak = '{"end" if before else "start"}', false)) AS use, (row_number() OVER (PARTITION BY a.site, a.fn ORDER BY {order}) - 1)::INTEGER AS r FROM tr a JOIN tr o ON a.site = o.site AND {when} WHERE a.mode = 'test' QUALIFY r < 5),
{side}s AS (SELECT p.site, p.fn, p.other, count(*) AS n, avg(abs(l.rssi - f.rssi)) AS diff FROM {side}1 p JOIN le l ON l.site = p.site AND l.fn = p.{last} JOIN fe f ON f.site = p.site AND f.fn = p.{first} AND f.emitter = l.emitter GROUP BY ALL),
{side}2 AS (SELECT p.*, CASE WHEN nl.n IS NULL OR nf.n IS NULL THEN -1 ELSE 2 * coalesce(s.n, 0) / (nl.n + nf.n)::DOUBLE END AS fraction, CASE WHEN nl.n IS NULL OR nf.n IS NULL THEN -1 ELSE coalesce(diff, 20) END AS mean FROM {side}1 p LEFT JOIN {side}s s USING (site, fn, other) LEFT JOIN nle nl ON nl.site = p.site AND nl.fn = p.{last} LEFT JOIN nfe nf ON nf.site = p.site AND nf.fn = p.{first}),
{side}3 AS (SELECT *, 10 * (1 - fraction) + mean + CASE WHEN fraction <= 0.1 THEN 15 ELSE 0 END + greatest(0, least(4, log2(greatest(delay, 1) / 10000.0))) AS dis, use AND dis < 12 AND device_id = own AS ok FROM {side}2),
{side}4 AS (SELECT *, ok AND NOT coalesce(list_contains(list(floor) OVER (PARTITION BY site, fn ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), floor), false) AS new FROM {side}3),
{side} AS (SELECT * FROM {side}4 QUALIFY row_number() OVER (PARTITION BY site, fn ORDER BY NOT new, r) = 1)"""


def _edge_columns(side: str, p: str) -> str:
    return f"""coalesce({p}.use, false) AS can_use_{side}, coalesce({p}.delay, -1) AS delay_{side}, round(coalesce(fraction_{p}, -1), 6) AS {side}_shared_fraction, round(coalesce(mean_{p}, -1), 6) AS {side}_mean_dist, round({p}.dis, 6) AS {side}_dissimilarity, coalesce({p}.mode, 'None') AS {side}_mode, {p}.other AS {side}_fn, {p}.device_id AS {side}_device_id, {p}.device_id + 10 AS {side}_device_id_drift, {p}.device_id + 20 AS {side}_device_id_merged, {p}.r AS {side}_match_offset_fn, {p}.floor AS {side}_floor, CASE WHEN {p}.use THEN {p}.x END AS {side}_x, CASE WHEN {p}.use THEN {p}.y END AS {side}_y, coalesce({p}.ok, false) AS reliable_{side}, CASE WHEN {p}.ok THEN {p}.device_id END AS reliable_{side}_device_id, CASE WHEN {p}.ok THEN {p}.floor END AS reliable_{side}_floor""".replace(f"fraction_{p}", f"{p}.fraction").replace(f"mean_{p}", f"{p}.mean")


def _edge_scan(name: str, f: str) -> str:
    return f"{name} AS (SELECT site, fn, emitter, arg_min(rssi, (heard, rssi)) AS rssi FROM (SELECT r.*, max(heard) OVER (PARTITION BY site, fn) AS newest FROM rd r JOIN (SELECT site, fn, {f}(scan) AS scan FROM rd GROUP BY ALL) USING (site, fn, scan)) WHERE newest - heard <= 10000 GROUP BY ALL), n{name} AS (SELECT site, fn, count(*) AS n FROM {name} GROUP BY ALL)"


@query(
    f"""WITH {TRAILS}, {_edge_scan("le", "max")}, {_edge_scan("fe", "min")}, {_side_sql("pr", True)}, {_side_sql("su", False)}
SELECT a.site, a.fn, a.num_waypoints, {_edge_columns("preceding", "pr")}, a.first_x, a.first_y, {_edge_columns("succeeding", "su")}, a.last_x, a.last_y, a.device_id AS actual_device_id, a.device_id + 10 AS actual_device_id_drift, a.device_id + 20 AS actual_device_id_merged, a.floor AS actual_floor
FROM tr a LEFT JOIN pr ON pr.site = a.site AND pr.fn = a.fn LEFT JOIN su ON su.site = a.site AND su.fn = a.fn WHERE a.mode = 'test'"""
)
def edge_positions(spark, d):
    """All 45 columns of the edge records of every seventh user's day, from what other users' days of its site tell."""
    e = events(spark, d).select((F.col("user_id") % 5).alias("site"), "user_id", F.floor(F.col("t") / 86_400_000_000).alias("day"), "t", "event_id", "value", "k").withColumn("fn", F.concat_ws("_", "user_id", "day"))
    at = F.struct("t", "event_id")
    ms = lambda c: F.floor(c / 1000)
    kind = (F.col("user_id") + F.col("day")) % 7
    ends = lambda f, n: [f("value", at).alias(f"{n}_x"), f("k", at).cast("double").alias(f"{n}_y")]
    g = e.groupBy("site", "user_id", "day", "fn").agg(ms(F.min("t")).alias("start_time"), ms(F.max("t")).alias("end_time"), F.count(F.lit(1)).alias("num_waypoints"), *ends(F.min_by, "first"), *ends(F.max_by, "last"))
    dev = F.col("user_id") % 4
    trails = g.withColumns(
        {
            "mode": F.when(kind == 0, "test").when(kind == 1, "valid").otherwise("train"), "floor": F.col("user_id") % 3, "device_id": dev, "device_id_drift": dev + 10, "device_id_merged": dev + 20,
            "path_order": F.lit(None).cast("int"), "path_device": F.lit(None).cast("int"), "leak": F.when(F.col("day") % 5 == 0, "start").when(F.col("day") % 5 == 1, "end"),
        }
    )
    readings = e.where("k is not null").select("site", "fn", F.floor(F.col("t") / 3_600_000_000).alias("scan"), ms(F.col("t")).alias("heard"), (F.col("k") % 5).alias("emitter"), (-40 - F.col("value") % 4).alias("rssi"))
    out = E.edge_records(trails, readings)
    return out.withColumns({c: R(c) for c in out.columns if "fraction" in c or "mean_dist" in c or "dissimilarity" in c})


@query(
    f"""WITH {EV}, c AS (SELECT *, unnest(range(CAST(ceil((t - 21600000000) / 21600000000.0) AS BIGINT), CAST(floor((t + 21600000000) / 21600000000.0) AS BIGINT) + 1)) * 21600000000 AS centre FROM e)
SELECT user_id, centre, count(*) AS n, round(count(*) / 12.0, 6) AS per_hour, round(avg(value), 6) AS mean FROM c GROUP BY ALL HAVING count(*) / 12.0 >= 0.2"""
)
def frequent_windows(spark, d):
    """Windows of twelve hours every six that hold a reading in five hours or more often."""
    w = B.sliding(events(spark, d), ["user_id"], "t", "value", 21_600_000_000, 21_600_000_000)
    rate = F.col("n") / 12.0
    return w.where(rate >= 0.2).select("user_id", "centre", "n", R(rate).alias("per_hour"), R("mean").alias("mean"))


@query(
    f"WITH {EV}, s AS (SELECT user_id, t // 86400000000 AS day, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS sub, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next FROM s) SELECT user_id, sub + 1 AS sub_id, day, n FROM i WHERE next IS NOT NULL"
)
def segments_with_successor(spark, d):
    """Segments (a user's days) that another follows, named by the number of that one."""
    s = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    numbered = s.withColumns({"sub": F.row_number().over(w) - 1, "next": F.lead("day").over(w)})
    return numbered.where("next is not null").select("user_id", (F.col("sub") + 1).cast("bigint").alias("sub_id"), "day", "n")


_FLOORS = f"{EV}, r AS (SELECT user_id % 5 AS floor, user_id AS fn, t // 1000 AS t, k AS emitter, (-(value % 60) - 30) AS rssi, t // 1000 - event_id % 4 * 700 AS heard, 2400 + CASE WHEN k % 50 = 7 THEN event_id % 2 ELSE 0 END AS frequency FROM sc WHERE k IS NOT NULL)"


def _floor_scans(spark, d):
    e = events(spark, d)
    t = F.floor(F.col("t") / 1000)
    frequency = 2400 + F.when(F.col("k") % 50 == 7, F.col("event_id") % 2).otherwise(0)
    row = e.select((F.col("user_id") % 5).alias("floor"), F.col("user_id").alias("fn"), t.alias("t"), F.col("k").alias("emitter"), (-(F.col("value") % 60) - 30).alias("rssi"), (t - F.col("event_id") % 4 * 700).alias("heard"), frequency.alias("frequency"), (F.col("user_id") % 7 == 0).alias("held"), "event_type", "value")
    return row.where("event_type = 'view' and emitter is not null"), row.where("event_type = 'purchase'")


@query(
    f"""WITH {_FLOORS}, n AS (SELECT floor, count(DISTINCT fn) AS n FROM r GROUP BY 1), p AS (SELECT floor, emitter, count(*) AS rows_, count(DISTINCT fn) AS n_trails, count(DISTINCT frequency) AS f FROM r GROUP BY ALL)
SELECT floor, emitter, n_trails FROM p JOIN n USING (floor) WHERE rows_ >= greatest(1, 4 - greatest(0, 10 - n * 0.5)) AND n_trails >= least(n * 0.2, 3) AND f <= 1"""
)
def supported_emitters(spark, d):
    """Emitters that a floor's model keeps: one frequency, readings and trails enough for the floor's number of trails."""
    return LO.supported(_floor_scans(spark, d)[0], ["floor"], "fn", 4, 3)


@query()
def floor_errors(spark, d):
    """Every floor fitted from six sevenths of its trails, the others located by it."""
    scans, anchors = _floor_scans(spark, d)
    a = anchors.where("emitter is not null").select("floor", "fn", "t", (F.col("emitter") / 2.0).alias("x"), (F.col("value") % 50).alias("y"), "held")
    got = LO.floor_errors(scans.drop("event_type", "value"), a, ["floor"], "fn", "held", least_rows=4, least_trails=3)
    return got.withColumns({c: R(c, 5) for c in ("x_pred", "y_pred", "x_actual", "y_actual", "squared_error", "error")})


@query(
    f"""WITH {EV}, n AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id % 5 ORDER BY user_id) - 1 AS file_id FROM (SELECT DISTINCT user_id FROM e)),
lo AS (SELECT sc.user_id, sc.event_id, sc.t, a.t AS a0, a.value AS v0 FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t > a.t),
hi AS (SELECT lo.*, a.t AS a1, a.value AS v1 FROM lo ASOF LEFT JOIN an a ON lo.user_id = a.user_id AND lo.t <= a.t)
SELECT user_id % 5 AS floor, user_id, file_id, event_id, round(CASE WHEN a0 IS NULL THEN v1 WHEN a1 IS NULL THEN v0 ELSE v0 + (t - a0) / (a1 - a0)::DOUBLE * (v1 - v0) END, 6) AS place, CASE WHEN a0 IS NOT NULL AND a1 IS NOT NULL THEN round((t - a0) / (a1 - a0)::DOUBLE, 9) END AS fraction FROM hi JOIN n USING (user_id)"""
)
def interpolated_with_ordinals(spark, d):
    """Scans' places between anchors with their trail's number on the floor and the fraction of the way, above 0 and at most 1; none outside the anchors."""
    numbers = LO.with_ordinals(events(spark, d).select((F.col("user_id") % 5).alias("floor"), "user_id").distinct(), ["floor"], "user_id")
    a = events(spark, d, "purchase").select("user_id", F.col("t").alias("at"), F.col("value").alias("v"))
    views = events(spark, d, "view").select("user_id", "event_id", "t")
    got = A.bracket(A.interpolate(views, a, ["user_id"], "t", "at", ["v"]), a, ["user_id"], "t", "at", ["at"])
    fraction = F.when((F.col("lo_at") < F.col("t")) & (F.col("t") <= F.col("hi_at")), (F.col("t") - F.col("lo_at")) / (F.col("hi_at") - F.col("lo_at")))
    return got.join(numbers, "user_id").select("floor", "user_id", F.col("ordinal").cast("bigint").alias("file_id"), "event_id", R("v_at").alias("place"), R(fraction, 9).alias("fraction"))


@query(f"WITH {EV} SELECT k, count(*) AS n, count(DISTINCT user_id) AS trails, list_sum(list(value ORDER BY user_id, t, event_id)[1:3]) AS first_three, max(value) AS strongest FROM e WHERE k IS NOT NULL GROUP BY k")
def readings_by_emitter(spark, d):
    """Readings of all trails put together and dealt by emitter, in order of trail and time: the first three summed, and the strongest."""
    e = events(spark, d).where("k is not null")
    w = Window.partitionBy("k").orderBy("user_id", "t", "event_id")
    first = e.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda r: r["value"]).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("trails"), F.max("value").alias("strongest")).join(first, "k").select("k", "n", "trails", total.alias("first_three"), "strongest")


@query(
    "WITH p AS (SELECT p_brand AS floor, p_size::DOUBLE AS x, p_retailprice - 900 AS y, lead(p_size::DOUBLE) OVER w AS nx, lead(p_retailprice - 900) OVER w AS ny FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)), a AS (SELECT *, atan2(nx - x, ny - y) AS a FROM p WHERE nx IS NOT NULL AND x > 10 AND x < 40 AND y > 5 AND y < 700) SELECT floor, count(*) AS n, round(CASE WHEN count(*) > 1 THEN median(CASE WHEN a >= 0 THEN a ELSE a + 2 * pi() END) ELSE 999 END, 6) AS azimuth FROM a GROUP BY floor"
)
def azimuths_in_box(spark, d):
    """Median azimuth of the ways from parts inside a box to the next ones, 999 where there is one only."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = read(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"))
    p = p.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where(F.col("nx").isNotNull() & X.in_box(F.col("x"), F.col("y"), 10, 40, 5, 700))
    turned = X.azimuth(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    return p.groupBy(F.col("p_brand").alias("floor")).agg(F.count(F.lit(1)).alias("n"), R(X.median_or(turned, 999.0)).alias("azimuth"))
