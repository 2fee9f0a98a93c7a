"""Registered queries on scans, filters on groups, alignment of tables and grid reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import asof as A
from ..operators import frames as K
from ..operators import geometry as G
from ..operators import models as M
from ..operators import walls as L
from ..sources import logsource, tables
from ..sources.sinks import scratch
from .relational import MD5
from .series import EV, R, events, read
from .spatial import PT, points

#: Rows that a task groups by keys of which most occur once.
GROUP_ROWS = 250_000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def csv_records(spark, d):
    """Orders written as a folder of CSV files and scanned with the types asked for (a key as text), the filter pushed into the scan."""
    at = scratch(spark)
    read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority").write.option("header", "true").csv(at)
    kinds = {"o_orderkey": "bigint", "o_totalprice": "double"}
    return tables.read_csv(spark, at, kinds, "o_orderstatus = 'F'").drop("o_orderstatus")


@query(
    "SELECT (user_id % 5)::VARCHAR AS site, user_id::VARCHAR AS trail, 'TYPE_' || upper(event_type) AS tag, count(*) AS n, min(epoch_us(ts) // 1000) AS first_ts, sum(CAST(props->>'k' AS INTEGER))::BIGINT AS total FROM events WHERE user_id % 5 IN (1, 3) AND event_type IN ('view', 'purchase') AND epoch_us(ts) // 1000 >= 1704800000000 GROUP BY ALL"
)
def log_source(spark, d):
    """Events written as a folder of log files by site, many trails to a file so that files grow with the bytes, scanned by the log source with filters on place, kind and time."""
    at = scratch(spark)
    ms = F.floor(X.micros(F.col("ts")) / 1000)
    line = F.concat_ws("\t", ms.cast("string"), F.concat(F.lit("TYPE_"), F.upper("event_type")), F.get_json_object("props", "$.k"))
    e = read(spark, d, "events").select((F.col("user_id") % 5).alias("site"), F.col("user_id").alias("trail"), ms.alias("ms"), line.alias("line"))
    # A trail's records in blocks of 1000, each under a line that names the trail.
    n = e.withColumn("n", F.row_number().over(Window.partitionBy("site", "trail").orderBy("ms")))
    block = n.groupBy("site", "trail", F.floor(F.col("n") / 1000).alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    head = F.concat(F.lit("#\ttrail:"), F.col("trail").cast("string"))
    block.select("site", F.concat_ws("\n", head, F.col("lines.line")).alias("value")).write.partitionBy("site").option("maxRecordsPerFile", 5000).text(at)
    rec = logsource.read_logs(spark, at).where((F.col("ts") >= 1_704_800_000_000) & F.col("tag").isin("TYPE_VIEW", "TYPE_PURCHASE") & F.col("site").isin("1", "3"))
    return rec.groupBy("site", "trail", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.sum(F.get("values", F.lit(0)).cast("int")).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM lineitem")
def prune_columns(spark, d):
    return K.prune_named(read(spark, d, "lineitem"), ["status", "flag", "date", "tax", "discount"])


@query("WITH g AS (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) = 1) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN g USING (l_suppkey, l_partkey)")
def single_frequency(spark, d):
    """Readings of emitters heard on one frequency only: lines of a supplier's parts with one return flag."""
    return K.single_valued(read(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {EV}, m AS (SELECT *, max(t) OVER (PARTITION BY user_id, event_type) - t AS delay FROM e) SELECT user_id, event_id, delay FROM m WHERE delay <= 100000000000")
def recency_filter(spark, d):
    return K.recent(events(spark, d), ["user_id", "event_type"], "t", 100_000_000_000).select("user_id", "event_id", "delay")


@query(
    "WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderstatus AS s FROM orders), b AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderstatus AS s FROM orders WHERE o_totalprice > 20000) SELECT o_custkey, count(*) AS mismatches FROM a FULL JOIN b USING (o_custkey, n) WHERE a.s IS DISTINCT FROM b.s GROUP BY o_custkey"
)
def positional_join(spark, d):
    """Customers whose orders do not stand at the same places in two tables."""
    o = read(spark, d, "orders")
    return K.positional_mismatches(o, o.where("o_totalprice > 20000"), ["o_custkey"], ["o_orderkey"], "o_orderstatus")


@query(f"WITH {PT} SELECT a.id, b.id AS other, round(b.x - a.x, 6) AS dx, round(b.y - a.y, 6) AS dy, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance, round(atan2(b.y - a.y, b.x - a.x), 6) AS angle FROM p a JOIN p b ON a.floor = b.floor AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6")
def pair_geometry(spark, d):
    """Differences, distance and direction of every two points of a floor within six metres."""
    p = points(spark, d)
    places = p.groupBy("floor", "x", "y").agg(F.collect_list("id").alias("ids"))
    o = places.select("floor", F.col("ids").alias("others"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    dx, dy = F.col("rx") - F.col("x"), F.col("ry") - F.col("y")
    near = G.near_pairs(places, o, ["floor"], 6.0).select("ids", "others", R(dx).alias("dx"), R(dy).alias("dy"), R("distance").alias("distance"), R(F.atan2(dy, dx)).alias("angle"))
    return near.withColumn("id", F.explode("ids")).withColumn("other", F.explode("others")).where("id != other").select("id", "other", "dx", "dy", "distance", "angle")


@query()
def active_ranges(spark, d):
    """Emitters' active times in chunks of six hours: a place is a user, near it is itself and the next user."""
    e = events(spark, d).where("k is not null").withColumn("chunk", F.floor(F.col("t") / 21_600_000_000))
    span = e.agg(F.min("chunk").alias("all_min"), F.max("chunk").alias("all_max"))
    seen = e.select("user_id", "chunk").distinct()
    near = seen.unionByName(seen.withColumn("user_id", F.col("user_id") - 1)).groupBy("user_id").agg(F.collect_set("chunk").alias("near_times"))
    own = e.groupBy("k").agg(F.min("chunk").alias("own_min"), F.max("chunk").alias("own_max"))
    rows = e.select("k", "user_id").distinct().join(near, "user_id").join(own, "k").join(F.broadcast(span))
    return K.active_range(rows, ["k"], "user_id", 2)


@query("SELECT o_custkey, coalesce(a.n, 0) AS orders, a.top, b.late FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderkey) AS late FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)")
def column_concat(spark, d):
    """Two tables of one index side by side."""
    o = read(spark, d, "orders")
    a = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("top"))
    b = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("late"))
    return a.join(b, "o_custkey", "full").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query(
    "WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem QUALIFY r <= 5), g AS (SELECT l_orderkey, count(*) AS n, list(l_quantity ORDER BY r) AS v FROM r GROUP BY 1) SELECT l_orderkey, n::INTEGER AS n, coalesce(v[1], 0) AS v1, coalesce(v[2], 0) AS v2, coalesce(v[3], 0) AS v3, coalesce(v[4], 0) AS v4, coalesce(v[5], 0) AS v5 FROM g"
)
def padded_sequences(spark, d):
    p = K.padded(read(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_quantity", 5)
    return p.select("l_orderkey", "n", *[F.col("values")[i].alias(f"v{i + 1}") for i in range(5)])


@query(
    f"WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal, {MD5.format('h')} / 4294967296.0 AS u, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN ln(greatest(u, 1e-12)) / c_acctbal END DESC NULLS LAST, c_custkey) AS r FROM c) SELECT c_nationkey, c_custkey, c_acctbal > 0 AND r <= greatest(1, floor(n * 0.08)) AS drawn FROM r"
)
def stratified_holdout(spark, d):
    """Of each floor (nation) 8 % of the trajectories (customers) and one at least, by weight."""
    c = read(spark, d, "customer")
    return K.stratified_draw(c, ["c_nationkey"], "c_custkey", X.hash_unit(F.col("c_custkey"), "h"), F.col("c_acctbal"), 0.08).select("c_nationkey", "c_custkey", "drawn")


@query(f"WITH {EV}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e) SELECT user_id, CASE WHEN avg(gap) / 3600000000.0 < 300 THEN -2 ELSE -1 END AS device FROM g GROUP BY 1")
def device_split(spark, d):
    """Trajectories of no known device in two kinds by their mean step."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    gap = F.col("t") - F.lag("t").over(w)
    return events(spark, d).withColumn("gap", gap).groupBy("user_id").agg(F.when(F.avg("gap") / 3_600_000_000 < 300, -2).otherwise(-1).alias("device"))


@query(
    "WITH m AS (SELECT l_orderkey, l_linenumber * 100 AS t1, max((l_partkey % 50) - 20) AS t2 FROM lineitem GROUP BY ALL) SELECT l_orderkey, 200 - min(t1 - t2) AS start_time, 200 - min(t1 - t2) + max(t1) AS end_time, min(t1 - t2) AS offset_ms FROM m GROUP BY 1"
)
def time_reconstruction(spark, d):
    """Start of a trajectory from the least lead of its batch times over the newest reading in the batch."""
    m = read(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 100).alias("t1")).agg(F.max(F.col("l_partkey") % 50 - 20).alias("t2"))
    off = F.min(F.col("t1") - F.col("t2"))
    return m.groupBy("l_orderkey").agg((200 - off).alias("start_time"), (200 - off + F.max("t1")).alias("end_time"), off.alias("offset_ms"))


RING = f"""WITH {PT}, b AS (SELECT floor, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM p GROUP BY floor),
w AS (SELECT floor, 0 AS wall, x0, y0, x1, y0 AS y1 FROM b UNION ALL SELECT floor, 1, x1, y0, x1, y1 FROM b UNION ALL SELECT floor, 2, x1, y1, x0, y1 FROM b UNION ALL SELECT floor, 3, x0, y1, x0, y0 FROM b),
l AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM w), f AS (SELECT *, sum(len) OVER (PARTITION BY floor ORDER BY wall) - len AS fr, sum(len) OVER (PARTITION BY floor) AS around FROM l),
t AS (SELECT p.floor, id, x, y, wall, x0, y0, x1, y1, len, fr, around, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (len * len))) AS t FROM p JOIN f USING (floor)),
o AS (SELECT *, sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) AS to_wall, fr + t * len AS along FROM t),
n AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY to_wall, wall) = 1), k AS (SELECT * FROM n WHERE to_wall < 4)"""


def _ring(spark, d):
    b = points(spark, d).groupBy("floor").agg((F.min("x") - 1).alias("a"), (F.max("x") + 1).alias("b"), (F.min("y") - 1).alias("c"), (F.max("y") + 1).alias("e"))
    corner = [("a", "c", "b", "c"), ("b", "c", "b", "e"), ("b", "e", "a", "e"), ("a", "e", "a", "c")]
    walls = F.array(*[F.struct(F.lit(i).alias("wall"), *[F.col(v).alias(n) for v, n in zip(w, ("x0", "y0", "x1", "y1"), strict=True)]) for i, w in enumerate(corner)])
    return b.select("floor", F.explode(walls).alias("w")).select("floor", "w.*")


@query(RING + " SELECT floor, id, round(to_wall, 6) AS to_wall, round(along, 6) AS along, round(coalesce(lead(along) OVER (PARTITION BY floor ORDER BY along, id), min(along) OVER (PARTITION BY floor) + around) - along, 6) AS gap FROM k")
def near_wall_points(spark, d):
    """Points near a floor's outline (its box): how far from it, where along it, and the gap to the next."""
    return K.near_walls(points(spark, d), _ring(spark, d), ["floor"], "id", 4.0).withColumns({c: R(c) for c in ("to_wall", "along", "gap")})


@query(RING + " SELECT k.floor, k.id, round(min(sqrt((k.x - r.x) ** 2 + (k.y - r.y) ** 2)), 6) AS to_rest FROM k JOIN p r ON r.floor = k.floor AND r.id NOT IN (SELECT id FROM k) GROUP BY ALL")
def near_wall_to_rest(spark, d):
    """From each point near the outline the way to the nearest that is not, by rings of cells."""
    p = points(spark, d)
    near = p.join(K.near_walls(p, _ring(spark, d), ["floor"], "id", 4.0).select("id").hint("merge"), "id")
    rest = p.join(near.select("id").hint("merge"), "id", "left_anti").select("floor", F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return G.knn(near.select("floor", "id", "x", "y"), rest, ["floor"], "id", "other", 1).select("floor", "id", R("distance").alias("to_rest"))


GRID = f"{PT}, g AS (SELECT floor, id AS cand, x, y, 'known' AS source FROM p WHERE id % 4 = 0 UNION ALL SELECT floor, -id, round(x / 5) * 5, round(y / 5) * 5, 'grid' FROM p WHERE id % 4 = 1 UNION ALL SELECT floor, 1000000 + id, x + 0.5, y, 'wall' FROM p WHERE id % 4 = 2)"


def _grid(spark, d):
    p = points(spark, d)
    part = lambda k, cand, x, y, s: p.where(f"id % 4 = {k}").select("floor", F.expr(cand).alias("cand"), F.expr(x).alias("x"), F.expr(y).alias("y"), F.lit(s).alias("source"))
    return part(0, "id", "x", "y", "known").unionByName(part(1, "-id", "round(x / 5) * 5", "round(y / 5) * 5", "grid")).unionByName(part(2, "1000000 + id", "x + 0.5", "y", "wall"))


@query(f"WITH {GRID} SELECT floor, count(*) AS n, count(*) FILTER (source = 'known') AS known, count(*) FILTER (source = 'grid') AS grid, count(*) FILTER (source = 'wall') AS wall, count(DISTINCT (round(x, 6), round(y, 6))) AS places FROM g GROUP BY floor")
def combined_grid(spark, d):
    """Candidates of all sources by floor."""
    g = _grid(spark, d)
    n = lambda s: F.count_if(F.col("source") == s).alias(s)
    return g.groupBy("floor").agg(F.count(F.lit(1)).alias("n"), n("known"), n("grid"), n("wall"), F.count_distinct(F.struct(R("x"), R("y"))).alias("places"))


@query(f"WITH {GRID}, u AS (SELECT floor, id, x, y FROM p WHERE id % 4 = 3), n AS (SELECT u.floor, u.id, min(sqrt((u.x - g.x) ** 2 + (u.y - g.y) ** 2)) AS d FROM u LEFT JOIN g USING (floor) GROUP BY ALL) SELECT floor, count(*) AS unseen, count(*) FILTER (d <= 1) AS within_1, count(*) FILTER (d <= 3) AS within_3, round(avg(CASE WHEN d <= 8 THEN d END), 6) AS mean_within_8 FROM n GROUP BY floor")
def unseen_coverage(spark, d):
    """How near a floor's candidates come to anchors that no candidate was made from."""
    u = points(spark, d).where("id % 4 = 3")
    g = _grid(spark, d).select("floor", F.col("x").alias("rx"), F.col("y").alias("ry"))
    n = G.least_distance(u, g, ["floor"], 8.0)
    return n.groupBy("floor").agg(F.count(F.lit(1)).alias("unseen"), F.count_if(F.col("d") <= 1).alias("within_1"), F.count_if(F.col("d") <= 3).alias("within_3"), R(F.avg("d")).alias("mean_within_8"))


@query(f"WITH {PT}, s AS (SELECT floor, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY floor ORDER BY id)) SELECT floor, count(*) AS points, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS most, round(stddev_samp(d), 6) AS spread FROM s GROUP BY floor")
def floor_distances(spark, d):
    w = Window.partitionBy("floor").orderBy("id")
    s = points(spark, d).withColumn("d", X.euclid(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return s.groupBy("floor").agg(F.count(F.lit(1)).alias("points"), *[R(f("d")).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"), (F.stddev_samp, "spread"))])


@query("WITH g AS (SELECT l_suppkey, l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY ALL) SELECT l_suppkey, max(n) AS most_rows, max(d) AS most_parts FROM g GROUP BY 1")
def max_of_groups(spark, d):
    """Most rows and most parts of a supplier's orders; nearly every row is a group, so rows are dealt out once, to tasks of at most about ``GROUP_ROWS``."""
    li = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey")
    n = max(spark.sparkContext.defaultParallelism, -(-li.count() // GROUP_ROWS))
    g = li.repartition(n, "l_suppkey", "l_orderkey").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("d"))
    return g.groupBy("l_suppkey").agg(F.max("n").alias("most_rows"), F.max("d").alias("most_parts"))


@query(f"WITH {EV} SELECT user_id, event_type, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) = 1")
def first_in_order(spark, d):
    e = events(spark, d)
    return e.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct("t", "event_id")).alias("f")).select("user_id", "event_type", "f.*")


@query("SELECT s.c_nationkey, s.c_mktsegment, avg(o.o_totalprice) AS score, o.n IS NULL AS empty FROM (SELECT n.c_nationkey, m.c_mktsegment FROM (SELECT DISTINCT c_nationkey FROM customer) n, (SELECT DISTINCT c_mktsegment FROM customer) m) s LEFT JOIN (SELECT c_nationkey, c_mktsegment, avg(o_totalprice) AS o_totalprice, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) o USING (c_nationkey, c_mktsegment) GROUP BY ALL".replace("avg(o.o_totalprice)", "round(avg(o.o_totalprice) + 1e-6, 3)"))
def reference_scores(spark, d):
    """Mean score of every site and floor, null where there is none."""
    c = read(spark, d, "customer")
    every = c.select("c_nationkey").distinct().join(F.broadcast(c.select("c_mktsegment").distinct()))
    scored = read(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    s = scored.groupBy("c_nationkey", "c_mktsegment").agg(R(F.avg("o_totalprice") + 1e-6, 3).alias("score"))
    return every.join(s, ["c_nationkey", "c_mktsegment"], "left").withColumn("empty", F.col("score").isNull())


@query("SELECT o_custkey, bool_and(o_totalprice > 10000) AS every_dear, bool_or(o_orderstatus = 'P') AS some_open, count(*) FILTER (o_orderstatus IS NULL) AS unknown FROM orders GROUP BY 1")
def all_of_group(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.every(F.col("o_totalprice") > 10000).alias("every_dear"), F.some(F.col("o_orderstatus") == "P").alias("some_open"), F.count_if(F.col("o_orderstatus").isNull()).alias("unknown"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity - lag(l_quantity) OVER w, 0) AS step, sum(l_quantity) OVER w AS path, l_quantity - min(l_quantity) OVER (PARTITION BY l_orderkey) AS above_least FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING)")
def steps_and_path(spark, d):
    """Difference to the row before (0 on the first), cumulative path and gap to the group's least."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(q - F.lag(q).over(w), F.lit(0.0)).alias("step"), F.sum(q).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("path"), (q - F.min(q).over(Window.partitionBy("l_orderkey"))).alias("above_least"))


@query(f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, {MD5.format('r').replace('c_custkey', 'o_orderkey')}, o_orderkey) AS rank FROM orders")
def rank_random_ties(spark, d):
    """Rank within a group, ties broken by a hash."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", X.hash_unit(F.col("o_orderkey"), "r"), "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def aligned_union(spark, d):
    """A union of tables of which one lacks a column."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("WITH m AS (SELECT o_custkey AS k, max(o_orderkey) AS v, 1 AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, max(o_orderkey), 2 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT c_custkey, -1, 3 FROM customer) SELECT k, arg_min(v, p) AS v, min(p) AS source FROM m GROUP BY k")
def merge_first_wins(spark, d):
    """Dictionaries merged, the first that has a key wins; keys of none take the fallback appended last."""
    o = read(spark, d, "orders")
    part = lambda s, p: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")).withColumn("p", F.lit(p))
    rest = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("bigint").alias("v"), F.lit(3).alias("p"))
    return part("F", 1).unionByName(part("O", 2)).unionByName(rest).groupBy("k").agg(F.min_by("v", "p").alias("v"), F.min("p").alias("source"))


@query("WITH p AS (SELECT o_orderkey, o_totalprice AS x, true AS predicted FROM orders WHERE o_orderkey % 3 <> 0) SELECT * FROM p UNION ALL SELECT o_orderkey, 0, false FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p)")
def append_missing(spark, d):
    """Rows not predicted are added back with a default."""
    o = read(spark, d, "orders")
    p = o.where("o_orderkey % 3 != 0").select("o_orderkey", F.col("o_totalprice").alias("x"), F.lit(True).alias("predicted"))
    return p.unionByName(o.join(p, "o_orderkey", "left_anti").select("o_orderkey", F.lit(0.0).alias("x"), F.lit(False).alias("predicted")))


@query(
    f"""WITH {EV}, c AS (SELECT *, unnest(range(CAST(ceil((t - 21600000000) / 21600000000.0) AS BIGINT), CAST(floor((t + 21600000000) / 21600000000.0) AS BIGINT) + 1)) * 21600000000 AS centre FROM e),
g AS (SELECT user_id, centre, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM c GROUP BY ALL),
lo AS (SELECT g.*, a.t AS t0, a.value AS v0 FROM g ASOF LEFT JOIN an a ON g.user_id = a.user_id AND g.centre > a.t),
hi AS (SELECT lo.*, a.t AS t1, a.value AS v1 FROM lo ASOF LEFT JOIN an a ON lo.user_id = a.user_id AND lo.centre <= a.t)
SELECT user_id, centre, n, round(n / 12.0, 6) AS hz, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (centre - t0) / (t1 - t0) END, 5) AS place,
  coalesce(least(centre - t0, t1 - centre) <= 43200000000, centre - t0 <= 43200000000, t1 - centre <= 43200000000, false) AS near_anchor FROM hi"""
)
def sliding_window_places(spark, d):
    """Windows of half a day either side of each six hours: frequency, moments, the interpolated place of the centre and whether an anchor is near."""
    e = events(spark, d)
    step = 21_600_000_000
    c = e.withColumn("i", F.explode(F.sequence(F.ceil((F.col("t") - step) / step), F.floor((F.col("t") + step) / step)))).withColumn("centre", F.col("i") * F.lit(step))
    g = c.groupBy("user_id", "centre").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    an = events(spark, d, "purchase").select("user_id", F.col("t").alias("at"), "value")
    a = A.asof(g, an.withColumnsRenamed({"at": "t0", "value": "v0"}), ["user_id"], "centre", "t0", ["t0", "v0"], "backward", True)
    b = A.asof(a, an.withColumnsRenamed({"at": "t1", "value": "v1"}), ["user_id"], "centre", "t1", ["t1", "v1"], "forward", False)
    place = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("centre") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    gap = F.least(F.col("centre") - F.col("t0"), F.col("t1") - F.col("centre"))
    return b.select("user_id", "centre", "n", R(F.col("n") / 12.0).alias("hz"), R("mean").alias("mean"), R("std").alias("std"), R(place, 5).alias("place"), F.coalesce(gap <= 43_200_000_000, F.lit(False)).alias("near_anchor"))


@query()
def candidate_grid(spark, d):
    """Candidates of each floor from its outline (the box of its parts, brand and block of 2000 keys) and a quarter of its points as known ones."""
    p = read(spark, d, "part").select(F.concat_ws("_", "p_brand", F.floor(F.col("p_partkey") / 2000)).alias("floor"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), ((F.col("p_retailprice") - 900) / 20).alias("y"))
    b = p.groupBy("floor").agg((F.min("x") - 1).alias("a"), (F.max("x") + 1).alias("b"), (F.min("y") - 1).alias("c"), (F.max("y") + 1).alias("e"))
    corner = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "c"), ("b", "c"), ("b", "e"), ("a", "e"))])
    ring = b.select("floor", F.posexplode(corner).alias("i", "p")).select("floor", "i", "p.*")
    return L.generate_from_known(ring, p.where("id % 4 = 0").select("floor", "x", "y"), ["floor"]).withColumns({"x": R("x"), "y": R("y")})


def _emitters(spark, d):
    e = events(spark, d).where("k is not null")
    return e.select(F.lit(0).alias("site"), F.col("k").alias("emitter"), (F.col("user_id") % 40).cast("double").alias("x"), (F.floor(F.col("user_id") / 40)).cast("double").alias("y"), F.bround(-30 - F.col("value") % 60, 0).alias("rssi"), "user_id")


@query()
def emitter_fit(spark, d):
    """Place, power and error of every emitter from all its readings."""
    return M.fit_emitters(_emitters(spark, d).select("site", "emitter", "x", "y", "rssi"), ["site", "emitter"])


@query()
def emitter_locate(spark, d):
    """Users located by fitted emitters, each from all its readings."""
    return M.locate_by_emitters(_emitters(spark, d).select("site", "user_id", "emitter", "rssi"), emitter_fit(spark, d), ["site"], ["user_id"])


@query("WITH b AS (SELECT o_custkey, o_orderkey % 3 AS fit, avg(o_totalprice) AS p FROM orders GROUP BY ALL) SELECT o_custkey, round(avg(p), 4) AS p FROM b GROUP BY o_custkey")
def bagged_mean(spark, d):
    """Mean over three fits (means of a third of the rows each)."""
    b = read(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 3).alias("fit")).agg(F.avg("o_totalprice").alias("p"))
    return M.bag(b, ["o_custkey"], ["p"]).withColumn("p", R("p", 4))


@query(
    """WITH w AS (SELECT user_id % 5 AS g, user_id, count(*)::DOUBLE AS n, avg(value) AS m, coalesce(stddev_pop(value), 0) AS s FROM events GROUP BY ALL), q AS (SELECT * FROM w WHERE user_id % 3 = 0), r AS (SELECT * FROM w WHERE user_id % 3 <> 0),
v AS (SELECT g, stddev_pop(n) AS dn, stddev_pop(m) AS dm, stddev_pop(s) AS ds FROM r GROUP BY g), u AS (SELECT *, (dn + dm + ds) / 3 / 10 AS low FROM v),
j AS (SELECT q.g, q.user_id, r.user_id AS other, round((coalesce(abs(q.n - r.n) / nullif(greatest(dn, low), 0), 0) + coalesce(abs(q.m - r.m) / nullif(greatest(dm, low), 0), 0) + coalesce(abs(q.s - r.s) / nullif(greatest(ds, low), 0), 0)) / 3, 9) AS gap FROM q JOIN u USING (g) JOIN r USING (g))
SELECT g, user_id, arg_min(other, struct_pack(gap := gap, o := other)) AS other, round(min(gap), 5) AS difference FROM j GROUP BY g, user_id"""
)
def signature_match(spark, d):
    """Windows are split as the models are: every third user is one to be placed, the others are the known ones; of each of the former the most alike known one in number, mean and spread of readings."""
    w = read(spark, d, "events").groupBy((F.col("user_id") % 5).alias("g"), "user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("s"))
    q = w.where("user_id % 3 = 0")
    r = w.where("user_id % 3 != 0").withColumnRenamed("user_id", "other").toDF("g", "other", "n", "m", "s")
    return M.nearest_signature(q, r, ["g"], "user_id", "other", ["n", "m", "s"]).withColumn("difference", R("difference", 5))
