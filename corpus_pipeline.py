"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all
but the last return the columns they were given, whatever their names; of an
empty table each makes an empty one, and texts of any length are read whole. ``run`` writes what a stage
returns in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.common import cut, table
from trailmark.llm.op2_near_dedup import near_duplicates
from trailmark.llm.op4_langid import held_out, identify, learn
from trailmark.llm.op5_sharding import shard_documents
from trailmark.llm.op6_mixing import mix
from trailmark.llm.op10_decontaminate import leaks


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns named by their place, which no operator's own column clashes with, and those names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _with_key(docs: DataFrame, at: dict[str, str]) -> DataFrame:
    """Rows by id (null: empty) and hash of the text."""
    return docs.withColumns({"d": F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), "t": F.xxhash64(F.col(at["text"]).cast("string"))})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; rejected ones go, null texts and texts without letters among them."""
    rows, at = _plain(docs)
    dicts = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return identify(rows, dicts, text=at["text"], keep_text=True).where("not rejected").select(*rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id (null first); a repeated row stays once, a text without words always."""
    rows, at = _plain(docs)
    first = near_duplicates(rows, at["text"], at["doc_id"], weighted=True).where("first").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.col("th").alias("h")).distinct()
    # near_duplicates hashes a null text as the empty one.
    keyed = _with_key(rows, at).withColumn("h", F.xxhash64(F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))))
    kept = keyed.join(first, ["d", "h"]).withColumn("n", F.row_number().over(Window.partitionBy("d", "h").orderBy("h")))
    return kept.where("n = 1").select(*rows.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none."""
    rows, at = _plain(docs)
    found = leaks(rows, table(spark, sf_dir, "benchmark"), at["text"], at["doc_id"])
    bad = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.col("th").alias("t")).distinct()
    return _with_key(rows, at).join(bad, ["d", "t"], "left_anti").select(*rows.columns).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so rows may repeat; a null source is a source."""
    rows, at = _plain(docs)
    got = mix(rows, at["text"], at["source"], at["doc_id"]).where("copies > 0")
    return got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*rows.columns).toDF(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; columns named like its results are replaced."""
    return shard_documents(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No SQL expresses compression, signatures, tiling or rounding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
