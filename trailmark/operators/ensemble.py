"""Choosing between plans, and ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose_plan(df: DataFrame, base: str, others: list[str], identical: list[Column], bias: float = 0.11, threshold: float = 1.0666) -> DataFrame:
    """``ratios`` of the base penalty to each other plan's, less ``bias`` per index and 100 where identical, and ``plan``.

    The plan is the first with the largest ratio, from 1, if that is above
    ``threshold``; else 0, the base.
    """
    ratio = [F.try_divide(F.col(base), F.col(o)) - bias * i - F.when(same, 100.0).otherwise(0.0) for i, (o, same) in enumerate(zip(others, identical, strict=True))]
    df = df.withColumn("ratios", F.array(*ratio))
    best = F.array_max("ratios")
    return df.withColumn("plan", F.when(best > threshold, F.array_position("ratios", best)).otherwise(0).cast("int"))


def blend(df: DataFrame, by: list[str], threshold: float, ratio: str, values: list[str]) -> DataFrame:
    """Mean of the plans whose ratio is above ``threshold``."""
    return df.where(F.col(ratio) > threshold).groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def global_rank(df: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """``n``: the row's number from 1 by ``bucket`` (an integer) and ``order``, without sorting all rows in one task.

    Rows are numbered within a bucket; what smaller buckets hold is added from
    their counts.
    """
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    w = Window.partitionBy(bucket).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).join(before, bucket).withColumn("n", F.col("__b") + F.col("__n")).drop("__n", "__b")
