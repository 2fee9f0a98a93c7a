"""Helpers shared by the operators: reading, lineage cuts, text keys."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "/tmp/checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(at)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives a lost executor.

    What ``drop_cut`` does not delete sooner goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(schema).parquet(path)


def drop_cut(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete written intermediates that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def meet(rows: DataFrame, small: DataFrame, key: str, n: int, id_: str, limit: int = 100_000, salts: int = 64) -> DataFrame:
    """``rows`` with what ``small`` (``n`` rows, one a ``key``) has for them, none of its keys being one task.

    Up to ``limit`` rows are broadcast; more meet on the key and a salt from ``id_``.
    """
    if n <= limit:
        return rows.join(F.broadcast(small), key)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(id_), F.lit(salts)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def by_place(df: DataFrame, needed: tuple[str, ...], new: set[str]) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``df`` with its columns named by their place, so that none clashes with an operator's own; the name each has, and those that come back.

    Columns with names of ``new`` (in any case of letters) do not come back; of
    them only ``needed`` ones are read.
    """
    kept = [c for c in df.columns if c.lower() not in new]
    names = {c: f"c{i}" for i, c in enumerate(df.columns) if c in kept or c in needed}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names, kept


def text_key(text: Column) -> Column:
    """32-byte digest of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
