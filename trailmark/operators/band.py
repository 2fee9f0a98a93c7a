"""Band joins, interval segments and sliding windows as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof


def band_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, width: int) -> DataFrame:
    """Pairs of a key whose times differ by ``width`` at most.

    Right rows are copied to their own bucket and both neighbours, so the join is
    an equality on key and bucket; a time span is never joined whole.
    """
    size = max(int(width), 1)
    l_ = left.withColumn("__b", F.floor(F.col(on) / size))
    r = right.withColumn("__b", F.explode(F.sequence(F.floor((F.col(right_on) - width) / size), F.floor((F.col(right_on) + width) / size))))
    return l_.join(r, [*by, "__b"]).where(F.abs(F.col(on) - F.col(right_on)) <= width).drop("__b")


def strongest_near(readings: DataFrame, scans: DataFrame, by: list[str], emitter: str, on: str, scan_on: str, value: str, width: int, tie: list[str]) -> DataFrame:
    """Per scan and emitter the strongest reading within ``width``; ties by ``tie`` ascending."""
    pairs = band_join(scans, readings, by, scan_on, on, width)
    best = F.max_by(F.struct(value, on), F.struct(F.col(value), *[-F.col(t) for t in tie])).alias("__best")
    return pairs.groupBy(*by, emitter, scan_on).agg(best).select(*by, emitter, scan_on, F.col("__best")[value].alias(value), F.col("__best")[on].alias("read_at"))


def anchor_intervals(anchors: DataFrame, by: list[str], on: str) -> DataFrame:
    """``sub_id, start, end``: consecutive anchors of a key, numbered from 0."""
    w = Window.partitionBy(*by).orderBy(on)
    return anchors.select(*by, on).withColumns({"sub_id": F.row_number().over(w) - 1, "start": F.col(on), "end": F.lead(on).over(w)}).where("end is not null").drop(on)


def interval_segments(rows: DataFrame, anchors: DataFrame, by: list[str], on: str, anchor_on: str) -> DataFrame:
    """Rows cut at anchors: each interval has its rows, the one at or before its start and the one at or after its end.

    A row is in an interval if its successor is after the start and its
    predecessor before the end; as-of look-ups of both neighbours give the first
    and last such interval, so the join is an equality on the interval.
    """
    w = Window.partitionBy(*by).orderBy(on)
    top = 2**62
    seen = rows.withColumns({"__prev": F.coalesce(F.lag(on).over(w), F.lit(-top)), "__next": F.coalesce(F.lead(on).over(w), F.lit(top))})
    at = Window.partitionBy(*by).orderBy(anchor_on)
    places = anchors.select(*by, F.col(anchor_on).alias("__a"), (F.row_number().over(at) - 1).alias("__first"))
    one = asof(seen, places, by, "__prev", "__a", ["__first"])
    two = asof(one, places.withColumnRenamed("__first", "__last"), by, "__next", "__a", ["__last"], strict=True)
    ids = two.where("__last is not null").withColumn("sub_id", F.explode(F.sequence(F.coalesce("__first", F.lit(0)), F.greatest(F.coalesce("__first", F.lit(0)), F.col("__last")))))
    return ids.drop("__prev", "__next", "__first", "__last").join(anchor_intervals(anchors, by, anchor_on), [*by, "sub_id"])


def coverage(segments: DataFrame, by: list[str], on: str) -> DataFrame:
    """The share of each interval that its rows span."""
    g = segments.groupBy(*by, "sub_id", "start", "end").agg(F.min(on).alias("__lo"), F.max(on).alias("__hi"))
    return g.select(*by, "sub_id", ((F.least("end", "__hi") - F.greatest("start", "__lo")) / (F.col("end") - F.col("start"))).alias("coverage"))


def sliding(rows: DataFrame, by: list[str], on: str, value: str, step: int, half: int, min_rows: int = 1) -> DataFrame:
    """Centres every ``step`` with count, mean and population deviation of rows within ``half``, both edges included.

    Centres are multiples of ``step``; a row is copied to the few it belongs to.
    """
    first = F.ceil((F.col(on) - half) / step)
    last = F.floor((F.col(on) + half) / step)
    spread = rows.select(*by, on, value).where(first <= last).withColumn("centre", F.explode(F.sequence(first, last))).withColumn("centre", F.col("centre") * step)
    return spread.groupBy(*by, "centre").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).where(F.col("n") >= min_rows)
