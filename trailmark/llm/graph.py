"""Connected components of an undirected graph, distributed and iterative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _roots(parent: DataFrame) -> DataFrame:
    """Follow ``node, root`` pointers, each to a lesser node, to the end: every round doubles the way."""
    spark = parent.sparkSession
    while True:
        to = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(parent.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_cut(spark, parent)
        parent = new.select("node", "root")
        if new.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v of one orderable type) to ``node, label``: the least node reached.

    Each round hooks every node to its least neighbour below it, follows the
    hooks to their roots, and keeps only the edges between different roots, so a
    star is one round and what is left shrinks fast. Edges of a node with itself
    are ignored; nodes without other edges do not appear.
    """
    spark = edges.sparkSession
    left = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    labels = cut(left.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    while not left.isEmpty():
        roots = _roots(cut(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))))
        new_labels = cut(labels.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        one = left.join(roots.withColumnRenamed("node", "u").withColumnRenamed("root", "ru"), "u")
        two = one.join(roots.withColumnRenamed("node", "v").withColumnRenamed("root", "rv"), "v", "left").select("ru", F.coalesce("rv", "v").alias("rv"))
        new_left = cut(two.where("ru != rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())
        drop_cut(spark, left, labels, roots)
        left, labels = new_left, new_labels
    return labels
