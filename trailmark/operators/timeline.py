"""Per-key timelines: lags and leads, change flags, islands, running fractions, neighbouring trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import signed_log10


def lag_lead(df: DataFrame, by: list[str], order: list[str], values: list[str], time: str, k: int) -> DataFrame:
    """For each of k places before and after: the values, null outside the key, and the signed log10 of the time between."""
    w = Window.partitionBy(*by).orderBy(*order)
    new: dict[str, Column] = {}
    for i in [*range(-k, 0), *range(1, k + 1)]:
        tag = f"m{-i}" if i < 0 else f"p{i}"
        at = lambda c, i=i: F.lag(c, -i).over(w) if i < 0 else F.lead(c, i).over(w)
        new |= {f"{v}_{tag}": at(v) for v in values}
        new[f"dt_{tag}"] = signed_log10(at(time) - F.col(time))
    return df.withColumns(new)


def neighbour_sum(value: str, by: list[str], order: list[str], k: int) -> Column:
    """Sum over k rows either side without the row itself; null where there are none."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.nullif(F.coalesce(F.sum(value).over(w.rowsBetween(-k, -1)), F.lit(0)) + F.coalesce(F.sum(value).over(w.rowsBetween(1, k)), F.lit(0)), F.lit(0))


def changed(value: str, by: list[str], order: list[str]) -> Column:
    """Whether the value differs from the row before; true on the first."""
    return F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(*by).orderBy(*order))) | (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1), F.lit(True))


def islands(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of rows with a true flag: ``island`` number from 1 with its first and last row and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("__n", F.row_number().over(w)).where(flag)
    df = df.withColumn("__g", F.col("__n") - F.row_number().over(w))
    got = df.groupBy(*by, "__g").agg(F.min("__n").alias("first_row"), F.max("__n").alias("last_row"), F.count(F.lit(1)).alias("length"))
    return got.withColumn("island", F.row_number().over(Window.partitionBy(*by).orderBy("first_row"))).drop("__g")


def running_fraction(value: str, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return F.try_divide(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(Window.partitionBy(*by)))


def suffix_sum(value: str, by: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))


def displacement(df: DataFrame, by: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Step to the next row (dx, dy, dist) and the same step in the frame of the step before (fwd, side)."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumns({"dx": F.lead(x).over(w) - F.col(x), "dy": F.lead(y).over(w) - F.col(y)})
    heading = F.lag(F.atan2("dy", "dx")).over(w)
    c, s = F.cos(heading), F.sin(heading)
    return df.withColumns({"dist": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "fwd": F.col("dx") * c + F.col("dy") * s, "side": F.col("dy") * c - F.col("dx") * s})


def segment_meta(segments: DataFrame, by: list[str], on: str, low: float, high: float) -> DataFrame:
    """Duration, rows, offsets and time steps of each segment; the robust mean is of steps within [low, high]."""
    w = Window.partitionBy(*by, "sub_id").orderBy(on)
    d = segments.withColumn("__d", F.col(on) - F.lag(on).over(w))
    return d.groupBy(*by, "sub_id").agg(
        F.first(F.col("end") - F.col("start")).alias("duration"),
        F.count(F.lit(1)).alias("num_obs"),
        (F.min(on) - F.first("start")).alias("start_offset"),
        (F.max(on) - F.first("end")).alias("end_offset"),
        F.avg("__d").alias("mean_step"),
        F.avg(F.when(F.col("__d").between(low, high), F.col("__d"))).alias("robust_step"),
        F.min("__d").alias("min_step"),
        F.max("__d").alias("max_step"),
    )


def edge_similarity(first: DataFrame, second: DataFrame, pairs: DataFrame, a: str, b: str, item: str, value: str, missing: float = 20.0) -> DataFrame:
    """``fraction`` of shared items, 2 * shared / (items of both), and ``mean`` difference of their values, for pairs (a, b).

    ``first`` and ``second`` have key, item and value; -1 for both where a side has
    no items, ``missing`` as mean where none is shared.
    """
    left = first.select(F.col("key").alias(a), F.col(item), F.col(value).alias("__x"))
    right = second.select(F.col("key").alias(b), F.col(item), F.col(value).alias("__y"))
    shared = pairs.join(left, a).join(right, [b, item]).groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"), F.avg(F.abs(F.col("__x") - F.col("__y"))).alias("diff"))
    na = left.groupBy(a).agg(F.count(F.lit(1)).alias("na"))
    nb = right.groupBy(b).agg(F.count(F.lit(1)).alias("nb"))
    got = pairs.join(na, a, "left").join(nb, b, "left").join(shared, [a, b], "left")
    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    return got.select(
        *pairs.columns,
        F.when(both, 2 * F.coalesce("shared", F.lit(0)) / (F.col("na") + F.col("nb"))).otherwise(-1.0).alias("fraction"),
        F.when(both, F.coalesce("diff", F.lit(missing))).otherwise(-1.0).alias("mean"),
    )


def dissimilarity(fraction: Column, mean: Column, delay_ms: Column) -> Column:
    """10 for nothing shared, the mean difference, 15 more if hardly anything is shared, and up to 4 for the delay."""
    late = F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.log2(F.greatest(delay_ms, F.lit(1)) / 10000.0)))
    return 10 * (1 - fraction) + mean + F.when(fraction <= 0.1, 15.0).otherwise(0.0) + late
