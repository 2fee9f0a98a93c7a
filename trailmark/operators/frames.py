"""Small table operators: pruning, filters on groups, draws, alignment, padding, active ranges, walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prune_named(df: DataFrame, parts: list[str]) -> DataFrame:
    """``df`` without the columns whose name holds one of ``parts``."""
    return df.select([c for c in df.columns if not any(p in c for p in parts)])


def single_valued(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows of groups with one value only; nulls are no value."""
    one = df.groupBy(*by).agg(F.min(value).alias("__a"), F.max(value).alias("__b")).where("__a = __b").select(*by)
    return df.join(one, by, "left_semi")


def recent(df: DataFrame, by: list[str], time: str, limit: float) -> DataFrame:
    """Rows at most ``limit`` older than the newest of their group, with that ``delay``."""
    newest = F.max(time).over(Window.partitionBy(*by))
    return df.withColumn("delay", newest - F.col(time)).where(F.col("delay") <= limit)


def positional_mismatches(left: DataFrame, right: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """By group the rows whose ``key`` differs at the same place of both tables, missing ones included; groups that agree are absent."""
    w = Window.partitionBy(*by).orderBy(*order)
    a = left.select(*by, F.row_number().over(w).alias("__n"), F.col(key).alias("__a"))
    b = right.select(*by, F.row_number().over(w).alias("__n"), F.col(key).alias("__b"))
    return a.join(b, [*by, "__n"], "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).groupBy(*by).agg(F.count(F.lit(1)).alias("mismatches"))


def stratified_draw(df: DataFrame, by: list[str], key: str, u: Column, weight: Column, share: float) -> DataFrame:
    """Of every group at least one row and ``share`` of its rows, drawn with chance proportional to ``weight``, as ``drawn``.

    ``u`` is uniform and fixed by the row, so reruns agree: the draw takes the
    greatest log(u) / weight. Rows without weight are never drawn. A group is
    ranked in one window, which sees a key and a number of each row.
    """
    can = weight > 0
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(can, F.ln(F.greatest(u, F.lit(1e-12))) / weight).desc_nulls_last(), key))
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*by)) * share))
    return df.withColumn("drawn", can & (rank <= n))


def padded(df: DataFrame, by: list[str], order: list[str], value: str, length: int, pad: float = 0.0) -> DataFrame:
    """One row a group with exactly ``length`` values: its first ones in order, then ``pad``; ``n`` is how many are real."""
    rows = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= length)
    got = rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", value))), lambda s: s[value]).alias("v"), F.count(F.lit(1)).cast("int").alias("n"))
    return got.select(*by, "n", F.concat("v", F.array_repeat(F.lit(pad), F.lit(length) - F.size("v"))).alias("values"))


def active_range(df: DataFrame, by: list[str], order: str, margin: int) -> DataFrame:
    """When an emitter was there, from the times it was heard and those at which places near its readings were visited without it.

    A row is a reading's place in ``order``: near_times (array of times at which it
    or places near it were visited), and, the same in all rows of a group,
    own_min, own_max (heard), all_min, all_max (observed). The range starts as
    wide as all observations; each place in turn draws its ends in to the visit
    nearest outside the heard times with their ``margin``. Returns active_from,
    active_to.
    """
    first = lambda c: F.min(c).alias(c)
    g = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "near_times"))).alias("p"), *[first(c) for c in ("own_min", "own_max", "all_min", "all_max")])
    low, high = F.greatest("all_min", F.col("own_min") - margin), F.least("all_max", F.col("own_max") + margin)
    start = F.struct((F.col("all_min") - 1).alias("lo"), (F.col("all_max") + 1).alias("hi"))

    def step(s: Column, p: Column) -> Column:
        later = F.array_max(F.filter(p["near_times"], lambda t: (t > high) & (t < s["hi"] - 1)))
        sooner = F.array_min(F.filter(p["near_times"], lambda t: (t < low) & (t > s["lo"] + 1)))
        return F.struct(F.coalesce(sooner - 1, s["lo"]).alias("lo"), F.coalesce(later + 1, s["hi"]).alias("hi"))

    return g.withColumn("r", F.aggregate("p", start, step)).select(*by, F.col("r.lo").alias("active_from"), F.col("r.hi").alias("active_to"))


def near_walls(points: DataFrame, walls: DataFrame, by: list[str], key: str, within: float) -> DataFrame:
    """Points (x, y) nearer than ``within`` to a closed ring: distance to it, place along it, and the gap to the next such point.

    ``walls`` has the ring's segments in order: wall, x0, y0, x1, y1. A floor's
    points meet its walls, which are few. The last point's gap leads round to the
    first; a point alone has the whole ring.
    """
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    ring = Window.partitionBy(*by).orderBy("wall")
    w = walls.withColumn("len", length).withColumns({"from": F.sum("len").over(ring) - F.col("len"), "around": F.sum("len").over(Window.partitionBy(*by))})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / (F.col("len") * F.col("len"))))
    met = points.join(w.where("len > 0"), by).withColumn("t", t)
    off = F.sqrt(F.pow(F.col("x") - F.col("x0") - F.col("t") * dx, 2) + F.pow(F.col("y") - F.col("y0") - F.col("t") * dy, 2))
    best = met.withColumn("to_wall", off).groupBy(*by, key).agg(F.min(F.struct("to_wall", "wall", (F.col("from") + F.col("t") * F.col("len")).alias("along"), "around")).alias("m"))
    near = best.where(F.col("m.to_wall") < within).select(*by, key, "m.to_wall", "m.along", "m.around")
    order = Window.partitionBy(*by).orderBy("along", key)
    first = F.min("along").over(Window.partitionBy(*by))
    return near.withColumn("gap", F.coalesce(F.lead("along").over(order), first + F.col("around")) - F.col("along")).drop("around")
