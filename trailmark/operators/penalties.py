"""Penalty and correction expressions, and ordered searches, of the path optimiser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def off_grid(is_train: Column, nearest_train: Column, weight: float = 8.0, reach: float = 10.0) -> Column:
    """Nothing on a known point, else ``weight`` falling to 0 at ``reach`` from the nearest known one."""
    return F.greatest(F.lit(0.0), F.when(is_train, 0.0).otherwise(weight * (1 - nearest_train / reach)))


def density(value: Column, weight: float = 4.0, cap: float = 2.0) -> Column:
    return weight * F.least(F.lit(cap), F.greatest(F.lit(0.0), value - 1))


def edge(distance: Column, delay_s: Column, dissimilarity: Column, limit_s: float = 15.0, cap: float = 30.0) -> Column:
    """Distance from where the neighbouring trajectory ends, fading with delay and dissimilarity; at most ``cap``."""
    fade = F.greatest(F.lit(0.0), 1 - delay_s / limit_s) * F.greatest(F.lit(0.0), 1 - dissimilarity / 12.0)
    return F.least(F.lit(cap), distance * fade)


def unbiased_distance(distance: Column, section: Column, first: float = -0.3147, last: float = 0.1577, floor: float = 1.0) -> Column:
    """Distances of first and last segments without their known bias."""
    return F.when(section == "First", F.greatest(F.lit(floor), distance + first)).when(section == "Last", distance + last).otherwise(distance)


def corrected(distance: Column, correction: Column, threshold: float = 0.0) -> Column:
    return F.when(F.abs(correction) > threshold, distance * (1 + correction)).otherwise(distance)


def scan_penalty(df: DataFrame, by: list[str], distance: str, order: list[Column], near: int = 20, least: int = 10) -> DataFrame:
    """1.5 times the mean and 1.5 times the least of the ``least`` smallest of the ``near`` nearest rows' distances."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= near)
    v = Window.partitionBy(*by).orderBy(distance, "__r")
    small = rows.withColumn("__s", F.row_number().over(v)).where(F.col("__s") <= least)
    return small.groupBy(*by).agg((1.5 * F.avg(distance) + 1.5 * F.min(distance)).alias("penalty"))


def first_reliable(df: DataFrame, by: list[str], order: list[Column], floor: str, reliable: str, k: int = 5) -> DataFrame:
    """Of each key's first k candidates the first reliable one whose floor no earlier candidate had; else the first.

    ``tried`` is how many were looked at. All in one ordered array a key: no
    rounds over the data.
    """
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k)
    seen = F.min("__r").over(Window.partitionBy(*by, floor)) < F.col("__r")
    ok = ranked.withColumn("__ok", F.col(reliable) & ~seen)
    keep = [c for c in df.columns if c not in by]
    pick = F.min_by(F.struct(*keep), F.struct((~F.col("__ok")).cast("int"), "__r"))
    tried = F.coalesce(F.min(F.when(F.col("__ok"), F.col("__r"))), F.max("__r"))
    return ok.groupBy(*by).agg(pick.alias("__p"), tried.cast("bigint").alias("tried"), F.max("__ok").alias("found")).select(*by, "__p.*", "tried", "found")


def circular_median(df: DataFrame, by: list[str], order: str, value: str, half: int) -> DataFrame:
    """Median of each row and its ``half`` neighbours either side on a closed ring, as ``local``.

    The ring's ends are copied past each other as often as ``half`` asks, so a
    plain frame is enough; on a ring shorter than the frame rows count again.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    ring = df.withColumns({"__n": n, "__p": pos})
    copies = ring.withColumn("__c", F.explode(F.sequence(-F.ceil(half / F.col("__n")), F.ceil(half / F.col("__n"))))).withColumn("__q", F.col("__p") + F.col("__c") * F.col("__n"))
    near = copies.where((F.col("__q") >= -half) & (F.col("__q") < F.col("__n") + half))
    w = Window.partitionBy(*by).orderBy("__q").rowsBetween(-half, half)
    return near.withColumn("local", F.percentile(value, F.lit(0.5)).over(w)).where("__c = 0").drop("__n", "__p", "__c", "__q")
