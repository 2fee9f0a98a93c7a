"""Registered queries on corrections, penalties, agreement and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import penalties as N
from ..operators import stats as S
from .series import EV, R, events, read
from .spatial import PT, points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {PT}, t AS (SELECT p.*, id % 4 = 0 AS known FROM p), n AS (SELECT a.id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM t a JOIN t b ON a.floor = b.floor AND b.known GROUP BY a.id) SELECT t.id, round(CASE WHEN known THEN 0 ELSE greatest(0, 8 * (1 - d / 10)) END, 6) AS off_grid, round(4 * least(2, greatest(0, x / 10 - 1)), 6) AS dense FROM t JOIN n USING (id)")
def off_grid_penalty(spark, d):
    p = points(spark, d).withColumn("known", F.col("id") % 4 == 0)
    k = p.where("known").select("floor", F.col("x").alias("rx"), F.col("y").alias("ry"))
    # Beyond ten metres the penalty is nothing, whatever the distance.
    near = G.least_distance(p, k, ["floor"], 10.0)
    # A floor without known points has no penalties.
    return near.join(k.select("floor").distinct(), "floor", "left_semi").withColumn("d", F.coalesce("d", F.lit(10.0))).select("id", R(N.off_grid(F.col("known"), F.col("d"))).alias("off_grid"), R(N.density(F.col("x") / 10)).alias("dense"))


@query(f"WITH {EV}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY k, t) AS r FROM e), s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, r) AS s FROM r WHERE r <= 20) SELECT user_id, round(1.5 * avg(value) + 1.5 * min(value), 6) AS penalty FROM s WHERE s <= 10 GROUP BY user_id")
def scan_penalty(spark, d):
    return N.scan_penalty(events(spark, d), ["user_id"], "value", [F.col("k"), F.col("t")]).withColumn("penalty", R("penalty"))


@query("SELECT o_orderkey, round(least(30, o_totalprice / 10000 * greatest(0, 1 - (o_orderkey % 20) / 15.0) * greatest(0, 1 - (o_custkey % 17) / 12.0)) + 1e-9, 6) AS penalty FROM orders")
def edge_penalty(spark, d):
    return read(spark, d, "orders").select("o_orderkey", R(N.edge(F.col("o_totalprice") / 10000, (F.col("o_orderkey") % 20).cast("double"), (F.col("o_custkey") % 17).cast("double")) + 1e-9).alias("penalty"))


@query(
    "WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), s AS (SELECT *, CASE WHEN pos = 0 THEN 'First' WHEN pos = n - 1 THEN 'Last' ELSE 'Middle' END AS section FROM p) SELECT l_orderkey, pos, section, round(CASE section WHEN 'First' THEN greatest(1, l_quantity / 10 - 0.3147) WHEN 'Last' THEN l_quantity / 10 + 0.1577 ELSE l_quantity / 10 END, 6) AS distance, round(CASE WHEN abs(l_discount) > 0.05 THEN l_quantity * (1 + l_discount) ELSE l_quantity END, 6) AS corrected FROM s"
)
def distance_corrections(spark, d):
    p = S.position_labels(read(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return p.select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), "section", R(N.unbiased_distance(F.col("l_quantity") / 10, F.col("section"))).alias("distance"), R(N.corrected(F.col("l_quantity"), F.col("l_discount"), 0.05)).alias("corrected"))


@query(
    "WITH t AS (SELECT l_orderkey, max(l_tax) AS f, avg(l_tax) AS m, min(l_tax) AS l FROM lineitem GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, pos, round(CASE WHEN pos = 0 THEN f WHEN pos = n - 1 THEN l ELSE m END, 9) AS uncertainty FROM p JOIN t USING (l_orderkey)"
)
def spread_uncertainty(spark, d):
    li = read(spark, d, "lineitem")
    t = li.groupBy("l_orderkey").agg(F.max("l_tax").alias("f"), F.avg("l_tax").alias("m"), F.min("l_tax").alias("l"))
    p = S.position_labels(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]).join(t, "l_orderkey")
    u = F.when(F.col("section") == "First", F.col("f")).when(F.col("section") == "Last", F.col("l")).otherwise(F.col("m"))
    return p.select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), R(u, 9).alias("uncertainty"))


@query(
    "WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice > 300000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders QUALIFY r <= 5), s AS (SELECT *, ok AND min(r) OVER (PARTITION BY o_custkey, o_orderstatus) = r AS good FROM c), f AS (SELECT o_custkey, coalesce(min(r) FILTER (good), 1) AS pick, coalesce(min(r) FILTER (good), max(r)) AS tried, bool_or(good) AS found FROM s GROUP BY 1) SELECT f.o_custkey, s.o_orderkey, f.tried, f.found FROM f JOIN s ON s.o_custkey = f.o_custkey AND s.r = f.pick"
)
def first_reliable_candidate(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", (F.col("o_totalprice") > 300000).alias("ok"))
    return N.first_reliable(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus", "ok").select("o_custkey", "o_orderkey", "tried", "found")


@query("WITH s AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT a.p_partkey, median(b.p_size) AS local FROM s a, range(-4, 5) t(o) JOIN s b ON a.p_brand = b.p_brand AND b.i = (a.i + o + 4 * a.n) % a.n GROUP BY a.p_partkey")
def circular_median(spark, d):
    return N.circular_median(read(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey", "p_size", 4).select("p_partkey", "local")


@query(
    "WITH q AS (SELECT s_nationkey, list(DISTINCT s_suppkey % 20) AS k FROM supplier GROUP BY 1) SELECT a.s_nationkey AS x, b.s_nationkey AS y, len(list_intersect(a.k, b.k)) AS shared, len(a.k) - len(list_intersect(a.k, b.k)) AS only_x, len(list_intersect(a.k, b.k)) > 0.2 * len(a.k) AS alike FROM q a JOIN q b ON b.s_nationkey = a.s_nationkey + 1"
)
def set_overlap(spark, d):
    q = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_set(F.col("s_suppkey") % 20).alias("k"))
    r = q.select(F.col("s_nationkey").alias("y"), (F.col("s_nationkey") - 1).alias("s_nationkey"), F.col("k").alias("m"))
    both = F.size(F.array_intersect("k", "m")).cast("bigint")
    return q.join(r, "s_nationkey").select(F.col("s_nationkey").alias("x"), "y", both.alias("shared"), F.size(F.array_except("k", "m")).cast("bigint").alias("only_x"), (both > 0.2 * F.size("k")).alias("alike"))


@query(f"WITH {EV}, r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM e) SELECT user_id, " + ", ".join(f"max(k) FILTER (r = {i}) AS k{i}" for i in range(1, 6)) + " FROM r GROUP BY user_id")
def strongest_pivot(spark, d):
    top = S.top_k(events(spark, d), ["user_id"], [F.desc("value"), F.col("event_id")], 5)
    return top.groupBy("user_id").agg(*[F.max(F.when(F.col("rank") == i, F.col("k"))).alias(f"k{i}") for i in range(1, 6)])


@query(f"WITH {EV}, c AS (SELECT k, user_id, round_even(value / 10, 0) AS cell, max(value) AS top FROM e GROUP BY ALL) SELECT k, count(*) AS cells, count(DISTINCT user_id) AS users, max(top) AS strongest, round(avg(top), 6) AS mean FROM c GROUP BY k")
def emitter_stats(spark, d):
    c = events(spark, d).groupBy("k", "user_id", F.bround(F.col("value") / 10, 0).alias("cell")).agg(F.max("value").alias("top"))
    return c.groupBy("k").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("user_id").alias("users"), F.max("top").alias("strongest"), R(F.avg("top")).alias("mean"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) OVER w AS before, o_totalprice + coalesce(lead(o_totalprice) OVER w, 0) AS pair, lag(o_orderkey) OVER w IS NOT NULL AS has_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def segment_pairs(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    prev = F.lag(F.struct("o_orderkey", "o_totalprice")).over(w)
    return read(spark, d, "orders").withColumn("p", prev).select("o_orderkey", "o_custkey", "o_totalprice", F.col("p.o_totalprice").alias("before"), (F.col("o_totalprice") + F.coalesce(F.lead("o_totalprice").over(w), F.lit(0.0))).alias("pair"), F.col("p").isNotNull().alias("has_before"))


@query("WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 = 0), t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 <> 0) SELECT count(*) AS held, round(avg((t.o_custkey IS NOT NULL)::INTEGER), 6) AS covered FROM h LEFT JOIN t USING (o_custkey)")
def holdout_coverage(spark, d):
    o = read(spark, d, "orders")
    h = o.where("o_orderkey % 10 = 0").select("o_custkey").distinct()
    t = o.where("o_orderkey % 10 <> 0").select("o_custkey").distinct().withColumn("seen", F.lit(1))
    return h.join(t, "o_custkey", "left").agg(F.count(F.lit(1)).alias("held"), R(F.avg(F.coalesce("seen", F.lit(0)))).alias("covered"))


@query("WITH a AS (SELECT o_custkey, arg_max(o_orderstatus, o_totalprice) AS x, arg_min(o_orderstatus, o_totalprice) AS y, mode(o_orderpriority) AS z FROM orders GROUP BY 1) SELECT x, y, x = y AS agree, count(*) AS n FROM a GROUP BY ALL")
def agreement_table(spark, d):
    a = read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_totalprice").alias("x"), F.min_by("o_orderstatus", "o_totalprice").alias("y"))
    return a.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("agree", F.col("x") == F.col("y"))


@query("WITH a AS (SELECT o_orderkey, o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, o_totalprice * 1.5 AS x FROM orders WHERE o_orderkey % 3 = 0) SELECT count(*) FILTER (a.x IS NULL) AS only_b, count(*) FILTER (b.x IS NULL) AS only_a, count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS both, round(avg(abs(a.x - b.x)), 4) AS distance FROM a FULL JOIN b USING (o_orderkey)")
def compare_submissions(spark, d):
    o = read(spark, d, "orders")
    a = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice").alias("a"))
    b = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 1.5).alias("b"))
    return a.join(b, "o_orderkey", "full").agg(F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), R(F.avg(F.abs(F.col("a") - F.col("b"))), 4).alias("distance"))


@query(f"WITH {EV}, s AS (SELECT user_id, k, max(value) AS v FROM e GROUP BY ALL), g AS (SELECT a.user_id, b.user_id AS other, round(abs(a.v - b.v), 6) AS gap FROM s a JOIN s b ON a.k = b.k AND a.user_id <> b.user_id) SELECT user_id, min_by(other, struct_pack(g := gap, o := other)) AS other, min(gap) AS gap FROM g GROUP BY user_id")
def nearest_other_trail(spark, d):
    """Each user's nearest other by their strongest values at any shared emitter; equal gaps go to the least user.

    Only neighbours in value order are compared: the least two users of a value
    stand for all who have it.
    """
    s = events(spark, d).groupBy("user_id", "k").agg(F.max("value").alias("v")).where("k is not null and v is not null")
    least = F.min("user_id")
    g = s.groupBy("k", "v").agg(least.alias("a"))
    second = s.join(g, ["k", "v"]).where("user_id <> a").groupBy("k", "v").agg(least.alias("b"))
    w = Window.partitionBy("k").orderBy("v")
    at = F.struct(F.col("v").alias("w"), F.col("a").alias("other"))
    g = g.join(second, ["k", "v"], "left").withColumns({"lo": F.lag(at).over(w), "hi": F.lead(at).over(w)})
    same = F.struct(F.col("v").alias("w"), F.when(F.col("user_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    j = s.join(g, ["k", "v"]).select("user_id", "v", F.explode(F.array(same, "lo", "hi")).alias("o")).where("o.other is not null")
    best = F.min(F.struct(R(F.abs(F.col("v") - F.col("o.w"))).alias("gap"), F.col("o.other").alias("other"))).alias("m")
    return j.groupBy("user_id").agg(best).select("user_id", F.col("m.other").alias("other"), F.col("m.gap").alias("gap"))


@query(
    f"""WITH {EV}, s AS (SELECT user_id, k, max(value) AS v FROM e WHERE k IS NOT NULL AND value IS NOT NULL GROUP BY ALL), g AS (SELECT a.user_id, b.user_id AS other, round(abs(a.v - b.v), 6) AS gap FROM s a JOIN s b ON a.k = b.k AND a.user_id <> b.user_id),
n AS (SELECT user_id, min_by(other, struct_pack(g := gap, o := other)) AS other, min(gap) AS gap FROM g GROUP BY user_id)
SELECT n.user_id, n.other, gap, count(*) AS shared FROM n JOIN s a USING (user_id) JOIN s b ON b.user_id = n.other AND b.k = a.k GROUP BY ALL"""
)
def nearest_other_trail_all(spark, d):
    """``nearest_other_trail`` with the number of emitters that both have heard."""
    near = nearest_other_trail(spark, d)
    heard = events(spark, d).where("k is not null and value is not null").select("user_id", "k").distinct()
    own = near.join(heard, "user_id")
    return own.join(heard.withColumnRenamed("user_id", "other"), ["other", "k"]).groupBy("user_id", "other", "gap").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT p_size, x.code FROM (SELECT DISTINCT p_size FROM part) JOIN (SELECT p_size, dense_rank() OVER (ORDER BY n DESC, p_size::VARCHAR) - 1 AS code FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)) x USING (p_size)")
def frequency_encoding(spark, d):
    """Codes by falling frequency, equal ones by text."""
    c = read(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return c.select("p_size", (F.dense_rank().over(Window.orderBy(F.desc("n"), F.col("p_size").cast("string"))) - 1).cast("bigint").alias("code"))
