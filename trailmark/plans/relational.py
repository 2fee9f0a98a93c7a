"""Registered queries on keys, sets, groups, windows and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import ensemble as E
from ..operators import stats as S
from .series import R, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH k AS (SELECT o_orderkey, concat_ws('_', o_orderpriority, 'c' || o_custkey, lpad((epoch_ms(o_orderdate))::VARCHAR, 13, '0')) AS key FROM orders) SELECT o_orderkey, key, split_part(key, '_', 1) AS site, split_part(key, '_', 2) AS path, split_part(key, '_', 3)::BIGINT AS ts FROM k")
def key_parse_build(spark, d):
    o = read(spark, d, "orders").withColumn("key", X.key_of(F.col("o_orderpriority"), F.concat(F.lit("c"), "o_custkey"), X.millis(F.col("o_orderdate"))))
    return o.select("o_orderkey", "key", *[c.alias(n) for n, c in X.key_parts(F.col("key")).items()])


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 END AS level FROM orders")
def label_map_fallback(spark, d):
    return read(spark, d, "orders").select("o_orderkey", X.label_to_int(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2}, {"2-HIGH": 9, "3-MEDIUM": 3, "5-LOW": 5}).alias("level"))


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) THEN 'valid' ELSE 'train' END AS mode FROM customer")
def mode_overlay(spark, d):
    held = read(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("h", F.lit(True))
    return read(spark, d, "customer").join(held, "c_custkey", "left").select("c_custkey", F.when(F.col("h"), "valid").otherwise("train").alias("mode"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(l_shipdate) AS shipped, max(epoch_us(l_shipdate)) OVER (PARTITION BY l_orderkey) AS latest, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def batch_max_transform(spark, d):
    w = Window.partitionBy("l_orderkey")
    shipped = X.micros(F.col("l_shipdate"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", shipped.alias("shipped"), F.max(shipped).over(w).alias("latest"), F.count(F.lit(1)).over(w).alias("n"))


@query("WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT round(avg(l_quantity), 6) AS mean_q, round(stddev_pop(l_quantity), 6) AS std_q, min(l_quantity) AS min_q, max(l_quantity) AS max_q, round(avg(l_discount), 6) AS mean_d, round(stddev_pop(l_discount), 6) AS std_d, (SELECT max(n) FROM g) AS max_rows, (SELECT max(s) FROM g) AS max_kinds FROM lineitem")
def global_channel_stats(spark, d):
    li = read(spark, d, "lineitem")
    s = li.agg(R(F.avg("l_quantity")).alias("mean_q"), R(F.stddev_pop("l_quantity")).alias("std_q"), F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"), R(F.avg("l_discount")).alias("mean_d"), R(F.stddev_pop("l_discount")).alias("std_d"))
    g = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("s")).agg(F.max("n").alias("max_rows"), F.max("s").alias("max_kinds"))
    return s.crossJoin(g)


@query("SELECT DISTINCT 'flag' AS kind, l_returnflag || l_linestatus AS value FROM lineitem UNION ALL SELECT DISTINCT 'brand', p_brand FROM part UNION ALL SELECT DISTINCT 'type', p_type FROM part")
def distinct_sets(spark, d):
    one = read(spark, d, "lineitem").select(F.lit("flag").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("value")).distinct()
    p = read(spark, d, "part")
    return one.union(p.select(F.lit("brand"), "p_brand").distinct()).union(p.select(F.lit("type"), "p_type").distinct())


@query("SELECT p_brand, p_size, count(*) AS n, dense_rank() OVER (ORDER BY p_brand, p_size) - 1 AS id FROM part GROUP BY p_brand, p_size")
def distinct_with_dense_id(spark, d):
    g = read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("id", (F.dense_rank().over(Window.orderBy("p_brand", "p_size")) - 1).cast("bigint"))


@query("SELECT l_returnflag, unnest(range(1, 10)) AS decile, round(unnest(quantile_cont(l_extendedprice::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])), 4) AS value FROM lineitem GROUP BY l_returnflag")
def deciles(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("q"))
    return g.select("l_returnflag", F.posexplode("q").alias("i", "v")).select("l_returnflag", (F.col("i") + 1).cast("bigint").alias("decile"), R("v", 4).alias("value"))


LW = "w AS (SELECT *, abs(l_quantity) / sum(abs(l_quantity)) OVER (PARTITION BY l_orderkey) AS weight FROM lineitem)"


@query(f"WITH {LW} SELECT l_orderkey, round(sum(weight * l_discount), 11) AS mean_error, round(sum(weight * abs(l_discount - 0.05)), 11) AS mean_abs_error FROM w GROUP BY l_orderkey")
def rel_weight_agg(spark, d):
    w = S.relative_weights(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity")
    return w.groupBy("l_orderkey").agg(R(F.sum(F.col("weight") * F.col("l_discount")), 11).alias("mean_error"), R(F.sum(F.col("weight") * F.abs(F.col("l_discount") - 0.05)), 11).alias("mean_abs_error"))


@query(
    f"""WITH {LW}, p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM w)
SELECT l_orderkey, arg_min(l_extendedprice, pos) AS first_value, round(sum(weight * l_extendedprice) FILTER (pos > 0 AND pos < n - 1) + 1e-9, 5) AS middle_value, arg_max(l_extendedprice, pos) AS last_value,
round(sum(weight) FILTER (pos > 0 AND pos < n - 1), 11) AS middle_weight, count(*) AS n_rows FROM p GROUP BY l_orderkey"""
)
def first_middle_last(spark, d):
    w = S.relative_weights(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity")
    g = S.first_middle_last(w, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_extendedprice", "weight")
    return g.withColumns({"middle_value": R(F.col("middle_value") + 1e-9, 5), "middle_weight": R("middle_weight", 11)})


@query("WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber, times FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY times DESC, l_linenumber) = 1")
def mode_tiebreak(spark, d):
    return S.mode_value(read(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot_counts(spark, d):
    return read(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().fillna(0)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) AS t, unnest(['quantity', 'discount', 'tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem")
def unpivot_measures(spark, d):
    return _measures(read(spark, d, "lineitem"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) AS t, unnest(['quantity', 'price', 'discount', 'tax']) AS measure, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem")
def unpivot_all_measures(spark, d):
    """With the price, that is all of a line's measures."""
    return _measures(read(spark, d, "lineitem"), {"price": "l_extendedprice"})


def _measures(li, more=None):
    measures = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"} | (more or {})
    ids = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.micros(F.col("l_shipdate")).alias("t"), *[F.col(c).alias(n) for n, c in measures.items()])
    return ids.unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t"], list(measures), "measure", "value")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS large, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1, 2")
def crosstab_conditional(spark, d):
    return read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("large"), R(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', k FROM (SELECT k FROM a UNION SELECT k FROM b)")
def set_ops(spark, d):
    a = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    b = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    tag = lambda df, t: df.select(F.lit(t).alias("part"), "k")
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "only_a")).union(tag(a.union(b).distinct(), "any"))


@query("SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS equal")
def set_equality(spark, d):
    a = read(spark, d, "nation").select(F.col("n_regionkey").alias("k")).distinct()
    b = read(spark, d, "region").select(F.col("r_regionkey").alias("k")).distinct()
    return a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full").agg((F.coalesce(F.sum(F.when(F.col("l").isNull() | F.col("r").isNull(), 1)), F.lit(0)) == 0).alias("equal"))


@query(
    """WITH p AS (SELECT l_orderkey, sum(l_quantity) AS base, sum(l_quantity * (1 - l_discount)) AS one, sum(l_quantity * (0.9 + l_tax)) AS two, bool_and(l_discount < 0.02) AS same FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, base / one - CASE WHEN same THEN 100 ELSE 0 END AS r1, base / two - 0.11 AS r2 FROM p)
SELECT l_orderkey, round(r1, 6) AS r1, round(r2, 6) AS r2, CASE WHEN greatest(r1, r2) > 1.0666 THEN CASE WHEN r1 >= r2 THEN 1 ELSE 2 END ELSE 0 END AS plan FROM r"""
)
def plan_ensemble(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("base"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("one"), F.sum(F.col("l_quantity") * (0.9 + F.col("l_tax"))).alias("two"), F.every(F.col("l_discount") < 0.02).alias("same"))
    got = E.choose_plan(g, "base", ["one", "two"], [F.col("same"), F.lit(False)], bias=0.11, threshold=1.0666)
    return got.select("l_orderkey", R(F.col("ratios")[0]).alias("r1"), R(F.col("ratios")[1]).alias("r2"), "plan")


@query("WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders), p AS (SELECT o_orderkey, round(o_totalprice / 1000, 3) AS x FROM orders WHERE o_orderkey % 3 = 0) SELECT t.n, t.o_orderkey, coalesce(p.x, -1) AS x FROM t LEFT JOIN p USING (o_orderkey)")
def submission_reorder(spark, d):
    o = read(spark, d, "orders")
    spread = o.select("o_orderkey", "o_orderdate", (F.datediff(F.lit("2100-01-01").cast("date"), F.col("o_orderdate").cast("date"))).alias("b"))
    t = E.global_rank(spread, "b", ["o_orderkey"])
    p = o.where("o_orderkey % 3 = 0").select("o_orderkey", R(F.col("o_totalprice") / 1000, 3).alias("x"))
    return t.join(p, "o_orderkey", "left").select("n", "o_orderkey", F.coalesce("x", F.lit(-1.0)).alias("x"))


MD5 = "concat('0x', substr(md5('{}' || c_custkey::VARCHAR), 1, 8))::BIGINT"


@query(f"SELECT c_custkey, ({MD5.format('s')} / 4294967296.0) AS u FROM customer WHERE c_acctbal > 0 ORDER BY ln(greatest({MD5.format('s')} / 4294967296.0, 1e-12)) / c_acctbal DESC, c_custkey LIMIT 100")
def weighted_sample_hash(spark, d):
    c = read(spark, d, "customer").withColumn("u", X.hash_unit(F.col("c_custkey"), "s"))
    return S.weighted_sample(c, "c_custkey", F.col("u"), "c_acctbal", 100).select("c_custkey", "u")


@query(f"SELECT c_custkey, ({MD5.format('f')} % 5)::INTEGER AS fold FROM customer")
def fold_assignment(spark, d):
    return read(spark, d, "customer").select("c_custkey", X.fold_of(F.col("c_custkey"), 5, "f").alias("fold"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 6) AS rmse, round(avg(abs(l_discount - l_tax)), 6) AS mae, round(avg((l_discount <> l_tax)::INTEGER), 6) AS changed, round(avg((abs(l_discount - 0.04) < abs(l_tax - 0.04))::INTEGER), 6) AS improved FROM lineitem GROUP BY l_returnflag")
def corr_metrics(spark, d):
    e = F.col("l_discount") - F.col("l_tax")
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(
        R(F.corr("l_quantity", "l_extendedprice")).alias("r"), R(F.sqrt(F.avg(e * e))).alias("rmse"), R(F.avg(F.abs(e))).alias("mae"), R(F.avg((F.col("l_discount") != F.col("l_tax")).cast("int"))).alias("changed"), R(F.avg((F.abs(F.col("l_discount") - 0.04) < F.abs(F.col("l_tax") - 0.04)).cast("int"))).alias("improved")
    )


@query(
    """WITH r AS (SELECT event_id, epoch_us(ts) // 1000 AS ts, 'TYPE_' || upper(event_type) AS tag, 2 AS n_values, '' || user_id AS first FROM events WHERE event_id % 7 <> 5
UNION ALL SELECT event_id, epoch_us(ts) // 1000 + 1, 'TYPE_WAYPOINT', 1, '' || event_id FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 5
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM events WHERE event_id % 7 = 5 AND event_id % 2 = 0) SELECT event_id, ts, tag, n_values::INTEGER AS n_values, first FROM r"""
)
def log_line_repair(spark, d):
    """Events as lines of a log: every third is glued to a record that follows it, some are comments, some have no tag."""
    from ..sources import logs

    ms = F.floor(X.micros(F.col("ts")) / 1000)
    line = F.concat_ws("\t", ms.cast("string"), F.concat(F.lit("TYPE_"), F.upper("event_type")), F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    glued = F.concat_ws("\t", F.concat(line, (ms + 1).cast("string")), F.lit("TYPE_WAYPOINT"), F.col("event_id").cast("string"))
    broken = F.when(F.col("event_id") % 2 == 0, "no tag").otherwise(F.concat(F.lit("# "), "event_type"))
    value = F.when(F.col("event_id") % 7 == 5, broken).when(F.col("event_id") % 3 == 0, glued).otherwise(line)
    rec = logs.repair(read(spark, d, "events").select("event_id", value.alias("value")))
    known = F.col("tag").isNotNull()
    return rec.select("event_id", "ts", "tag", F.when(known, F.size("values")).alias("n_values"), F.when(known, F.get("values", F.lit(0))).alias("first"))


@query("SELECT event_id, coalesce(CASE WHEN user_id < 20 THEN 500 END, CAST(props->>'k' AS INTEGER)) AS height FROM events")
def json_floor_override(spark, d):
    over = spark.range(20).select(F.col("id").alias("user_id"), F.lit(500).alias("h"))
    e = read(spark, d, "events").withColumn("j", F.from_json("props", "k int"))
    return e.join(F.broadcast(over), "user_id", "left").select("event_id", F.coalesce("h", "j.k").alias("height"))


@query("SELECT site, count(*) AS n, count(DISTINCT code) AS codes FROM (SELECT n_regionkey AS site, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY site")
def ordinal_encoding(spark, d):
    codes = read(spark, d, "customer").select("c_mktsegment").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1)
    j = read(spark, d, "customer").join(F.broadcast(codes), "c_mktsegment").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("site")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"))


@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem) SELECT l_orderkey, round(sum((l_quantity - m) / sd), 4) AS z FROM lineitem, s GROUP BY l_orderkey")
def standardise(spark, d):
    li = read(spark, d, "lineitem")
    s = li.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("sd"))
    return li.crossJoin(F.broadcast(s)).groupBy("l_orderkey").agg(R(F.sum((F.col("l_quantity") - F.col("m")) / F.col("sd")), 4).alias("z"))


@query("SELECT o_custkey, round(CASE WHEN sum(near) < sum(x) THEN 0 ELSE sum(near) END, 4) AS best FROM (SELECT o_custkey, o_totalprice AS x, o_totalprice * CASE WHEN o_orderstatus = 'P' THEN 1.5 ELSE 0.8 END AS near FROM orders) GROUP BY o_custkey")
def best_possible(spark, d):
    o = read(spark, d, "orders").withColumn("near", F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "P", 1.5).otherwise(0.8))
    return o.groupBy("o_custkey").agg(R(F.when(F.sum("near") < F.sum("o_totalprice"), 0.0).otherwise(F.sum("near")), 4).alias("best"))


@query("SELECT sum(2 ^ i)::BIGINT AS score, list(i ORDER BY i) AS members FROM (SELECT n_nationkey AS i FROM nation WHERE n_regionkey = 2)")
def membership_decode(spark, d):
    n = read(spark, d, "nation").where("n_regionkey = 2").agg(F.sum(F.pow(F.lit(2.0), F.col("n_nationkey"))).cast("bigint").alias("score"))
    bits = X.membership_bits(F.col("score"), 40)
    return n.select("score", F.filter(F.transform(bits, lambda b, i: F.when(b, i)), lambda x: x.isNotNull()).alias("members"))


@query("WITH a AS (SELECT l_orderkey, sum(l_tax) AS p FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, sum(l_discount) AS p FROM lineitem WHERE l_linenumber < 5 GROUP BY 1) SELECT l_orderkey, round(a.p, 6) AS mine, round(b.p, 6) AS other, round(a.p - coalesce(b.p, 0), 6) AS gain FROM a LEFT JOIN b USING (l_orderkey)")
def compare_penalties(spark, d):
    li = read(spark, d, "lineitem")
    a = li.groupBy("l_orderkey").agg(F.sum("l_tax").alias("a"))
    b = li.where("l_linenumber < 5").groupBy("l_orderkey").agg(F.sum("l_discount").alias("b"))
    return a.join(b, "l_orderkey", "left").select("l_orderkey", R("a").alias("mine"), R("b").alias("other"), R(F.col("a") - F.coalesce("b", F.lit(0.0))).alias("gain"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey")
def submission_order(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey")


@query("SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")) + " FROM lineitem")
def distinct_per_column(spark, d):
    return read(spark, d, "lineitem").agg(*[F.countDistinct(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")])


@query("WITH e AS (SELECT s_nationkey, abs(s_acctbal) / 1000 AS l FROM supplier), g AS (SELECT s_nationkey, count(*) AS n, avg(l) AS l FROM e GROUP BY 1) SELECT round(sum(sqrt(n) * l) / sum(sqrt(n)), 6) AS loss FROM g")
def site_weighted_loss(spark, d):
    g = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("s_acctbal") / 1000).alias("l"))
    return g.agg(R(F.sum(F.sqrt("n") * F.col("l")) / F.sum(F.sqrt("n"))).alias("loss"))
