"""Vectors of a query set against all rows, block by block: each pair of blocks is a task, what is left of it a few rows a query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a block of queries and of rows.
QUERIES, ROWS = 4096, 8192


def l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of one vector from the rows of ``b``."""
    return np.abs(b - a).sum(1)


def by_blocks(queries: DataFrame, rows: DataFrame, task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``task`` of every block of queries with every block of rows; neither side is gathered or sent whole."""
    n_q, n_r = queries.count(), rows.count()
    q_blocks, r_blocks = max(1, -(-n_q // QUERIES)), max(1, -(-n_r // min(ROWS, max(512, n_r // 16))))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = max(q_blocks * r_blocks, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = queries.withColumn("__q", block("vec_id", q_blocks)).withColumn("__r", every(r_blocks)).repartition(parts, "__q", "__r")
    r = rows.withColumn("__r", block("other", r_blocks)).withColumn("__q", every(q_blocks)).repartition(parts, "__q", "__r")
    return q.groupBy("__q", "__r").cogroup(r.groupBy("__q", "__r")).applyInPandas(task, schema)


def least_by_label(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Of every query (vec_id, a) and label (other_label) of ``rows`` (other, other_label, b) the least distance ``d`` to another row."""

    def task(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            r = r.sort_values("other_label", kind="stable")
            label, other, b = r["other_label"].to_numpy(), r["other"].to_numpy(), np.stack(r["b"].to_numpy()).astype(float)
            starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            for v, a in zip(q["vec_id"], q["a"], strict=True):
                d = np.where(other == v, np.inf, l1(np.asarray(a, float), b))
                least = np.minimum.reduceat(d, starts)
                # A label that has the query alone gives no row.
                found += [(v, label[s], x) for s, x in zip(starts, least, strict=True) if x < np.inf]
        return pd.DataFrame(found, columns=["vec_id", "other_label", "d"])

    part = by_blocks(queries, rows, task, "vec_id long, other_label int, d double")
    return part.groupBy("vec_id", "other_label").agg(F.min("d").alias("d"))


def nearest_of_label(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Of every query (vec_id, label, a) the ``k`` nearest other rows (other, other_label, b) of its label in each block, ties by id: vec_id, other, d."""

    def task(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        groups = dict(list(r.groupby("other_label"))) if len(r) else {}
        ids, others, away = [], [], []
        for label, own in q.groupby("label"):
            if label not in groups:
                continue
            other, b = groups[label]["other"].to_numpy(), np.stack(groups[label]["b"].to_numpy()).astype(float)
            for v, a in zip(own["vec_id"], own["a"], strict=True):
                d = l1(np.asarray(a, float), b)
                d[other == v] = np.inf
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                near = near[np.lexsort((other[near], d[near]))][:k]
                near = near[other[near] != v]
                ids += [v] * len(near)
                others += other[near].tolist()
                away += d[near].tolist()
        return pd.DataFrame({"vec_id": ids, "other": others, "d": away})

    return by_blocks(queries, rows, task, "vec_id long, other long, d double")
