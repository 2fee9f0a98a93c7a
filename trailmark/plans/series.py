"""Registered queries on time series: events as readings of a trajectory, orders as a customer's timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import asof as A
from ..operators import band as B
from ..operators import stats as S
from ..operators import timeline as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = read(spark, d, "events")
    e = e.where(F.col("event_type") == kind) if kind else e
    return e.select("user_id", "event_id", X.micros(F.col("ts")).alias("t"), "value", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


EV = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value, event_type, CAST(props->>'k' AS INTEGER) AS k FROM events), sc AS (SELECT * FROM e WHERE event_type = 'view'), an AS (SELECT * FROM e WHERE event_type = 'purchase')"
R = lambda c, n=6: F.round(c, n)


@query(
    f"""WITH {EV},
lo AS (SELECT sc.user_id, sc.event_id, a.t AS a0, a.value AS av FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t > a.t),
hi AS (SELECT sc.user_id, sc.event_id, a.t AS bt, a.value AS bv FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t <= a.t),
p AS (SELECT sc.user_id, sc.value, CASE WHEN a0 IS NULL THEN bv WHEN bt IS NULL THEN av ELSE av + (sc.t - a0) / (bt - a0)::DOUBLE * (bv - av) END AS v
      FROM sc JOIN lo USING (user_id, event_id) JOIN hi USING (user_id, event_id))
SELECT user_id, count(v) AS n, round(avg(abs(v - value)), 6) AS mean_error FROM p GROUP BY user_id"""
)
def interpolation_error(spark, d):
    """Purchases as anchors, views as scans: how far interpolated values are from the scans' own."""
    got = A.interpolate(events(spark, d, "view"), events(spark, d, "purchase").select("user_id", "t", "value").withColumnRenamed("value", "v"), ["user_id"], "t", "t", ["v"])
    return got.groupBy("user_id").agg(F.count("v_at").alias("n"), R(F.avg(F.abs(F.col("v_at") - F.col("value")))).alias("mean_error"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, min(epoch_us(ts)) AS first_t, max(epoch_us(ts)) AS last_t, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM events GROUP BY user_id")
def per_kind_counts(spark, d):
    e = events(spark, d)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min_by("value", "t").alias("first_value"), F.max_by("value", "t").alias("last_value"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) SELECT user_id FROM c GROUP BY user_id HAVING max(c) - min(c) = 0")
def uniform_groups(spark, d):
    return S.uniform_groups(events(spark, d), ["user_id"], "event_type")


@query(
    f"""WITH {EV}, n AS (SELECT count(DISTINCT user_id) AS n FROM e)
SELECT k, count(*) AS n_rows, count(DISTINCT user_id) AS n_groups FROM e, n GROUP BY k, n
HAVING count(*) >= greatest(1.0, 105 - greatest(0.0, 10 - n * 0.5)) AND count(DISTINCT user_id) >= least(0.2 * n, 60)"""
)
def adaptive_support(spark, d):
    return S.adaptive_support(events(spark, d), "k", "user_id", 105, 60)


@query(f"WITH {EV} SELECT user_id, k, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY value DESC, t, event_id) AS r FROM e) WHERE r = 1")
def strongest_reading(spark, d):
    best = F.max_by(F.struct("value", "event_id"), F.struct("value", -F.col("t"), -F.col("event_id")))
    return events(spark, d).groupBy("user_id", "k").agg(best.alias("b")).select("user_id", "k", "b.value", "b.event_id")


@query(
    f"""WITH {EV}, p AS (SELECT sc.user_id, sc.t AS scan_t, e.k, e.value, e.t, row_number() OVER (PARTITION BY sc.user_id, sc.t, e.k ORDER BY e.value DESC, e.t, e.event_id) AS r
FROM sc JOIN e ON sc.user_id = e.user_id AND abs(sc.t - e.t) <= 3600000000)
SELECT user_id, scan_t, k, value, t AS read_at FROM p WHERE r = 1"""
)
def band_strongest(spark, d):
    scans = events(spark, d, "view").select("user_id", F.col("t").alias("scan_t"))
    return B.strongest_near(events(spark, d).select("user_id", "k", "t", "value", "event_id"), scans, ["user_id"], "k", "t", "scan_t", "value", 3_600_000_000, ["t", "event_id"])


def _anchor(spark, d):
    return events(spark, d, "purchase").select("user_id", F.col("t").alias("a"), F.col("value").alias("av"))


@query(f"WITH {EV} SELECT sc.user_id, sc.t, a.t AS a, a.value AS av FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t >= a.t")
def asof_backward(spark, d):
    return A.asof(events(spark, d, "view").select("user_id", "t"), _anchor(spark, d), ["user_id"], "t", "a", ["a", "av"])


@query(f"WITH {EV}, f AS (SELECT user_id, min(t) AS first_a FROM an GROUP BY user_id) SELECT sc.user_id, sc.t, coalesce(a.t, f.first_a) AS a FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t >= a.t LEFT JOIN f ON f.user_id = sc.user_id")
def asof_clamped_first(spark, d):
    first = _anchor(spark, d).groupBy("user_id").agg(F.min("a").alias("f"))
    got = A.asof(events(spark, d, "view").select("user_id", "t"), _anchor(spark, d), ["user_id"], "t", "a", ["a"], slice_ms=86_400_000_000)
    return got.join(first, "user_id", "left").select("user_id", "t", F.coalesce("a", "f").alias("a"))


@query(
    f"""WITH {EV}, lo AS (SELECT an.user_id, an.t, s.t AS l FROM an ASOF LEFT JOIN sc s ON an.user_id = s.user_id AND an.t > s.t),
hi AS (SELECT an.user_id, an.t, s.t AS h FROM an ASOF LEFT JOIN sc s ON an.user_id = s.user_id AND an.t <= s.t)
SELECT user_id, t, round((t - coalesce(l, h)) / 1e6, 6) AS low_offset, round((coalesce(h, l) - t) / 1e6, 6) AS high_offset FROM lo JOIN hi USING (user_id, t)"""
)
def bracket_offsets(spark, d):
    scans = events(spark, d, "view").select("user_id", F.col("t").alias("s"))
    got = A.bracket(events(spark, d, "purchase").select("user_id", "t"), scans, ["user_id"], "t", "s", ["s"])
    return got.select("user_id", "t", R((F.col("t") - F.col("lo_s")) / 1e6).alias("low_offset"), R((F.col("hi_s") - F.col("t")) / 1e6).alias("high_offset"))


@query(
    f"""WITH {EV}, lo AS (SELECT sc.user_id, sc.t, a.t AS l FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t >= a.t),
hi AS (SELECT sc.user_id, sc.t, a.t AS h FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t <= a.t)
SELECT user_id, t, CASE WHEN h IS NULL OR t - l <= h - t THEN l ELSE h END AS near_t FROM lo JOIN hi USING (user_id, t)"""
)
def nearest_time(spark, d):
    return A.nearest(events(spark, d, "view").select("user_id", "t"), _anchor(spark, d), ["user_id"], "t", "a")


@query(
    f"""WITH {EV}, lo AS (SELECT sc.user_id, sc.event_id, a.t AS a0, a.value AS av FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t > a.t),
hi AS (SELECT sc.user_id, sc.event_id, a.t AS bt, a.value AS bv FROM sc ASOF LEFT JOIN an a ON sc.user_id = a.user_id AND sc.t <= a.t)
SELECT user_id, event_id, round(CASE WHEN a0 IS NULL THEN bv WHEN bt IS NULL THEN av ELSE av + (sc.t - a0) / (bt - a0)::DOUBLE * (bv - av) END, 6) AS v_at
FROM sc JOIN lo USING (user_id, event_id) JOIN hi USING (user_id, event_id)"""
)
def interpolate_clamped(spark, d):
    got = A.interpolate(events(spark, d, "view").select("user_id", "event_id", "t"), events(spark, d, "purchase").select("user_id", "t", F.col("value").alias("v")), ["user_id"], "t", "t", ["v"])
    return got.select("user_id", "event_id", R("v_at").alias("v_at"))


@query(f"WITH {EV}, s AS (SELECT user_id, min(t) AS a, max(t) AS b FROM an GROUP BY user_id) SELECT sc.user_id, sc.event_id FROM sc JOIN s USING (user_id) WHERE sc.t BETWEEN a - 60000000 AND b + 60000000")
def keep_window(spark, d):
    return A.keep_window(events(spark, d, "view"), events(spark, d, "purchase").select("user_id", "t"), ["user_id"], "t", "t", 60_000_000).select("user_id", "event_id")


@query(
    f"""WITH {EV}, hit AS (SELECT an.user_id, s.t FROM an ASOF JOIN sc s ON an.user_id = s.user_id AND an.t > s.t UNION SELECT an.user_id, s.t FROM an ASOF JOIN sc s ON an.user_id = s.user_id AND an.t <= s.t)
SELECT sc.user_id, sc.event_id, EXISTS (SELECT 1 FROM hit WHERE hit.user_id = sc.user_id AND hit.t = sc.t) AS near FROM sc"""
)
def near_anchor_flag(spark, d):
    return A.near_flags(events(spark, d, "view").select("user_id", "event_id", "t"), events(spark, d, "purchase").select("user_id", "t"), ["user_id"], "t", "t").select("user_id", "event_id", "near")


SEG = f"""WITH {EV}, n AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS q FROM e WHERE event_type <> 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY t)),
iv AS (SELECT user_id, row_number() OVER w - 1 AS sub_id, t AS a, lead(t) OVER w AS b FROM an WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT n.user_id, n.event_id, n.t, iv.sub_id, a, b FROM n JOIN iv ON iv.user_id = n.user_id AND b IS NOT NULL AND (q IS NULL OR q > a) AND (p IS NULL OR p < b))"""


def _segments(spark, d):
    rows = events(spark, d).where("event_type <> 'purchase'").select("user_id", "event_id", "t")
    return B.interval_segments(rows, events(spark, d, "purchase").select("user_id", "t"), ["user_id"], "t", "t")


@query(SEG + " SELECT user_id, event_id, sub_id FROM s")
def interval_segments(spark, d):
    return _segments(spark, d).select("user_id", "event_id", F.col("sub_id").cast("bigint").alias("sub_id"))


@query(
    SEG
    + """, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, sub_id ORDER BY t) AS dt FROM s)
SELECT user_id, sub_id, any_value(b - a) AS duration, count(*) AS num_obs, min(t) - any_value(a) AS start_offset, max(t) - any_value(b) AS end_offset,
round(avg(dt)) AS mean_step, round(avg(dt) FILTER (dt BETWEEN 1000000000 AND 20000000000)) AS robust_step, min(dt) AS min_step, max(dt) AS max_step FROM g GROUP BY user_id, sub_id"""
)
def segment_meta(spark, d):
    m = T.segment_meta(_segments(spark, d), ["user_id"], "t", 1e9, 2e10)
    return m.withColumns({"sub_id": F.col("sub_id").cast("bigint"), "mean_step": R("mean_step", 0), "robust_step": R("robust_step", 0)})


@query(SEG + " SELECT user_id, sub_id, round((least(any_value(b), max(t)) - greatest(any_value(a), min(t))) / (any_value(b) - any_value(a))::DOUBLE, 6) AS coverage FROM s GROUP BY user_id, sub_id")
def coverage_fraction(spark, d):
    return B.coverage(_segments(spark, d), ["user_id"], "t").select("user_id", F.col("sub_id").cast("bigint").alias("sub_id"), R("coverage").alias("coverage"))


MOVE = f"""WITH {EV}, m AS (SELECT user_id, event_id, t, lead(k) OVER w - k AS dx, lead(value) OVER w - value AS dy FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
h AS (SELECT *, lag(atan2(dy, dx)) OVER (PARTITION BY user_id ORDER BY t) AS h FROM m)"""


@query(MOVE + " SELECT user_id, event_id, dx, round(dy, 4) AS dy, round(sqrt(dx * dx + dy * dy), 4) AS dist, round(dx * cos(h) + dy * sin(h), 4) AS fwd, round(dy * cos(h) - dx * sin(h), 4) AS side FROM h")
def displacement_heading(spark, d):
    m = T.displacement(events(spark, d), ["user_id"], ["t"], "k", "value")
    return m.select("user_id", "event_id", "dx", *[R(c, 4).alias(c) for c in ("dy", "dist", "fwd", "side")])


@query(f"WITH {EV}, a AS (SELECT event_id, value - k AS a FROM e) SELECT event_id, round(a - 2 * pi() * ceil((a - pi()) / (2 * pi())), 6) AS angle, round(least(abs(a - 2 * pi() * ceil((a - pi()) / (2 * pi()))), 2 * pi() - abs(a - 2 * pi() * ceil((a - pi()) / (2 * pi())))), 6) AS turn FROM a")
def angle_wrap(spark, d):
    a = F.col("value") - F.col("k")
    return events(spark, d).select("event_id", R(X.wrap_angle(a)).alias("angle"), R(X.circular_diff(a, F.lit(0.0))).alias("turn"))


@query(
    f"""WITH {EV}, c AS (SELECT *, unnest(range(CAST(ceil((t - 21600000000) / 21600000000.0) AS BIGINT), CAST(floor((t + 21600000000) / 21600000000.0) AS BIGINT) + 1)) * 21600000000 AS centre FROM e)
SELECT user_id, centre, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM c GROUP BY user_id, centre HAVING count(*) >= 2"""
)
def sliding_window(spark, d):
    return B.sliding(events(spark, d), ["user_id"], "t", "value", 21_600_000_000, 21_600_000_000, 2).select("user_id", "centre", "n", R("mean").alias("mean"), R("std").alias("std"))


@query(
    f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM e),
f AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM n WHERE value > 20),
i AS (SELECT user_id, g, min(n) AS first_row, max(n) AS last_row, count(*) AS length FROM f GROUP BY user_id, g)
SELECT user_id, first_row, last_row, length, row_number() OVER (PARTITION BY user_id ORDER BY first_row) AS island FROM i"""
)
def islands(spark, d):
    return T.islands(events(spark, d), ["user_id"], ["t"], F.col("value") > 20)


def _timeline(spark, d):
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", X.micros(F.col("o_orderdate")).alias("t"), "o_totalprice", "o_orderstatus")


OR = "o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS t, o_totalprice, o_orderstatus FROM orders)"
OW = "WINDOW w AS (PARTITION BY o_custkey ORDER BY t, o_orderkey)"


def _sl(e: str) -> str:
    return f"round(sign({e}) * log10(nullif(abs({e}), 0)), 6)"


@query(
    f"WITH {OR} SELECT o_orderkey, "
    + ", ".join(f"{f}(o_totalprice, {i}) OVER w AS o_totalprice_{p}{i}, {_sl(f'({f}(t, {i}) OVER w - t)')} AS dt_{p}{i}" for f, p in (("lag", "m"), ("lead", "p")) for i in (1, 2, 3))
    + ", round(nullif(coalesce(sum(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(o_totalprice) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0), 0), 2) AS around FROM o "
    + OW
)
def lag_lead_matrix(spark, d):
    o = _timeline(spark, d)
    m = T.lag_lead(o, ["o_custkey"], ["t", "o_orderkey"], ["o_totalprice"], "t", 3)
    m = m.withColumn("around", R(T.neighbour_sum("o_totalprice", ["o_custkey"], ["t", "o_orderkey"], 3), 2))
    return m.select("o_orderkey", *[F.col(f"o_totalprice_{p}{i}") for p in "mp" for i in (1, 2, 3)], *[R(f"dt_{p}{i}").alias(f"dt_{p}{i}") for p in "mp" for i in (1, 2, 3)], "around")


@query(f"WITH {OR} SELECT o_orderkey, coalesce(o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w OR row_number() OVER w = 1, true) AS changed, round(o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS gap FROM o {OW}")
def change_flag(spark, d):
    gap = F.col("o_totalprice") - F.min("o_totalprice").over(Window.partitionBy("o_custkey"))
    return _timeline(spark, d).select("o_orderkey", T.changed("o_orderstatus", ["o_custkey"], ["t", "o_orderkey"]).alias("changed"), R(gap, 2).alias("gap"))


@query(f"WITH {OR} SELECT o_orderkey, coalesce(lag(o_orderstatus) OVER w, o_orderstatus) AS prev, coalesce(lead(o_orderstatus) OVER w, o_orderstatus) AS next, coalesce(lag(o_orderstatus) OVER w, o_orderstatus) = o_orderstatus AND coalesce(lead(o_orderstatus) OVER w, o_orderstatus) = o_orderstatus AS consistent FROM o {OW}")
def neighbour_consistency(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("t", "o_orderkey")
    o = _timeline(spark, d).withColumns({"prev": F.coalesce(F.lag("o_orderstatus").over(w), "o_orderstatus"), "next": F.coalesce(F.lead("o_orderstatus").over(w), "o_orderstatus")})
    return o.select("o_orderkey", "prev", "next", ((F.col("prev") == F.col("o_orderstatus")) & (F.col("next") == F.col("o_orderstatus"))).alias("consistent"))


@query(f"WITH {OR} SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS to_come, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS fraction FROM o {OW}")
def suffix_cumsum(spark, d):
    by, order = ["o_custkey"], ["t", "o_orderkey"]
    return _timeline(spark, d).select("o_orderkey", R(T.suffix_sum("o_totalprice", by, order), 2).alias("to_come"), R(T.running_fraction("o_totalprice", by, order)).alias("fraction"))


SESS = f"""{EV}, gap AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM e),
ses AS (SELECT *, user_id * 100000 + sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS key FROM gap),
item AS (SELECT key, k, max(value) AS value FROM ses GROUP BY key, k),
span AS (SELECT key, any_value(user_id) AS user_id, min(t) AS a, max(t) AS b FROM ses GROUP BY key),
nxt AS (SELECT key AS x, lead(key) OVER w AS y, a, b, lead(a) OVER w AS na FROM span WINDOW w AS (PARTITION BY user_id ORDER BY a))"""


def _sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("t")
    e = events(spark, d).withColumn("fresh", F.when(F.col("t") - F.lag("t").over(w) <= 43_200_000_000, 0).otherwise(1))
    e = e.withColumn("key", F.col("user_id") * 100000 + F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = e.groupBy("key", "k").agg(F.max("value").alias("value"))
    span = e.groupBy("key").agg(F.first("user_id").alias("user_id"), F.min("t").alias("a"), F.max("t").alias("b"))
    v = Window.partitionBy("user_id").orderBy("a")
    pairs = span.select(F.col("key").alias("x"), F.lead("key").over(v).alias("y"), ((F.lead("a").over(v) - F.col("b")) / 1000).alias("delay")).where("y is not null")
    return item, pairs


EDGE = f"""WITH {SESS}, sh AS (SELECT x, y, count(*) AS n, avg(abs(i.value - j.value)) AS d FROM nxt JOIN item i ON i.key = x JOIN item j ON j.key = y AND j.k = i.k WHERE y IS NOT NULL GROUP BY x, y),
na AS (SELECT key, count(*) AS n FROM item GROUP BY key),
r AS (SELECT nxt.x, nxt.y, (na - b) / 1000.0 AS delay, 2 * coalesce(sh.n, 0) / (a1.n + b1.n)::DOUBLE AS fraction, coalesce(d, 20) AS mean
FROM nxt JOIN na a1 ON a1.key = nxt.x JOIN na b1 ON b1.key = nxt.y LEFT JOIN sh ON sh.x = nxt.x AND sh.y = nxt.y WHERE nxt.y IS NOT NULL)"""


@query(EDGE + " SELECT x, y, round(fraction, 6) AS fraction, round(mean, 6) AS mean FROM r")
def edge_similarity(spark, d):
    item, pairs = _sessions(spark, d)
    got = T.edge_similarity(item, item, pairs, "x", "y", "k", "value")
    return got.select("x", "y", R("fraction").alias("fraction"), R("mean").alias("mean"))


@query(EDGE + ", s AS (SELECT *, 10 * (1 - fraction) + mean + CASE WHEN fraction <= 0.1 THEN 15 ELSE 0 END + greatest(0, least(4, log2(greatest(delay, 1) / 10000))) AS score FROM r) SELECT x, y, round(score, 6) AS score, score < 30 AS reliable FROM s")
def edge_match_reliable(spark, d):
    item, pairs = _sessions(spark, d)
    got = T.edge_similarity(item, item, pairs, "x", "y", "k", "value").withColumn("score", T.dissimilarity(F.col("fraction"), F.col("mean"), F.col("delay")))
    return got.select("x", "y", R("score").alias("score"), (F.col("score") < 30).alias("reliable"))


@query(f"WITH {EV}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM e) SELECT user_id, median(dt)::DOUBLE AS median_step, round(avg(dt) / 1e6, 4) AS mean_step FROM d GROUP BY user_id")
def step_medians(spark, d):
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))
    return events(spark, d).select("user_id", dt.alias("dt")).groupBy("user_id").agg(F.median("dt").alias("median_step"), R(F.avg("dt") / 1e6, 4).alias("mean_step"))


@query(f"WITH {EV}, g AS (SELECT *, floor((t - first_value(t) OVER (PARTITION BY user_id ORDER BY t)) / 1e6) AS off FROM e) SELECT event_id, off::BIGINT AS seconds FROM g")
def offset_from_first(spark, d):
    off = F.col("t") - F.min("t").over(Window.partitionBy("user_id"))
    return events(spark, d).select("event_id", F.floor(off / 1e6).alias("seconds"))


@query(f"WITH {EV}, l AS (SELECT user_id, k, list_sort(list(event_id)) AS ids FROM e GROUP BY user_id, k HAVING count(*) > 1) SELECT e.event_id, array_to_string(list_transform(l.ids, lambda x: x::VARCHAR), '-') AS label FROM e JOIN l USING (user_id, k)")
def revisit_labels(spark, d):
    e = events(spark, d)
    l_ = e.groupBy("user_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "-").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return e.join(l_, ["user_id", "k"]).select("event_id", "label")
