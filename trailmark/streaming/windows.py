"""Structured Streaming forms of the sliding window, the sessions and the most recent device.

Batch is the reference's only mode; these give the same results on a stream, up
to the watermark: a row later than that is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding(stream: DataFrame, by: list[str], ts: str, value: str, width: str, step: str, late: str) -> DataFrame:
    """Count, mean and population deviation of ``value`` in windows of ``width`` every ``step``."""
    w = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width, step).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std")


def sessions(stream: DataFrame, by: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Runs of rows no further than ``gap`` apart."""
    w = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_device(stream: DataFrame, site: str, trail: str, value: str, limit: float) -> DataFrame:
    """Device number of each trajectory of a site as it arrives: the most recently used one whose last value is within ``limit``, else a new one."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, values = (list(x) for x in state.get) if state.exists else ([], [])
        for pdf in frames:
            out = []
            for v in pdf[value]:
                hit = next((i for i, known in enumerate(values) if abs(known - v) <= limit), None)
                number = len(ids) if hit is None else ids.pop(hit)
                if hit is not None:
                    values.pop(hit)
                ids.insert(0, number)
                values.insert(0, float(v))
                out.append(number)
            yield pd.DataFrame({site: key[0], trail: pdf[trail].to_numpy(), "device": out})
        state.update((ids, values))

    kinds = dict(stream.dtypes)
    return stream.groupBy(site).applyInPandasWithState(step, f"{site} {kinds[site]}, {trail} {kinds[trail]}, device long", "ids array<long>, vals array<double>", "append", GroupStateTimeout.NoTimeout)
