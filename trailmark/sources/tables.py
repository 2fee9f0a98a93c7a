"""Table scans: CSV with explicit types, the first folder that exists, feedback files, GeoJSON outlines of any kind."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str | list[str], dtypes: Mapping[str, str] | None = None, where: Column | str | None = None) -> DataFrame:
    """CSV with a header: columns named in ``dtypes`` have those types, all others are strings; nothing is inferred.

    ``where`` is a filter the scan may push down. A value that does not fit its
    type is null.
    """
    names = spark.read.option("header", "true").csv(path).columns
    missing = sorted(set(dtypes or {}) - set(names))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    kind = lambda n: StructType.fromDDL(f"c {dtypes[n]}")[0].dataType if dtypes and n in dtypes else StringType()
    df = spark.read.schema(StructType([StructField(n, kind(n)) for n in names])).option("header", "true").option("enforceSchema", "false").csv(path)
    return df.where(where) if where is not None else df


def first_folder(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that exists, in whatever store it is."""
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return p
    raise FileNotFoundError(f"none of {paths}")


def trails_by_path(lines: DataFrame) -> DataFrame:
    """``lines`` (file) with mode, site, floor and trail from the path: train/site/floor/trail.txt or test/trail.txt."""
    part = lambda i: F.nullif(F.regexp_extract("file", r"/(train)/([^/]+)/([^/]+)/([^/]+)\.txt$", i), F.lit(""))
    test = F.nullif(F.regexp_extract("file", r"/(test)/([^/]+)\.txt$", 2), F.lit(""))
    return lines.withColumns({"mode": F.coalesce(part(1), F.when(test.isNotNull(), "test")), "site": part(2), "floor": part(3), "trail": F.coalesce(part(4), test)})


def kept_trails(summary: DataFrame) -> DataFrame:
    """Files of ``trails_by_path`` and ``file_summary`` that count: incomplete training files go, test files stay always."""
    return summary.where("mode = 'test' or complete")


def feedback(lines: DataFrame) -> DataFrame:
    """Submissions of a feedback page as text: ``n, name, delay, comment, score`` of blocks of name, delay, blank lines, comment, score, blank line.

    ``lines`` has file, i (line number) and value. A block begins at a line that
    ends in csv where the block before has its score; a score that is no number
    drops the block. Blocks are numbered by file.
    """
    w = Window.partitionBy("file").orderBy("i")
    text = lines.where("trim(value) != ''")
    name = text.withColumn("starts", F.col("value").endswith("csv") & ((F.row_number().over(w) == 1) | (F.lag("value", 1).over(w).try_cast("double").isNotNull()) | (F.lag("value", 1).over(w) == "Error")))
    block = name.withColumn("n", F.sum(F.col("starts").cast("int")).over(w)).where("n > 0")
    place = block.withColumn("p", F.row_number().over(Window.partitionBy("file", "n").orderBy("i")))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    one = place.groupBy("file", "n").agg(at(1).alias("name"), at(2).alias("delay"), at(3).alias("comment"), at(4).try_cast("double").alias("score"))
    return one.where("score is not null")


def outlines(geo: DataFrame) -> DataFrame:
    """``site, part, polygon, ring, i, x, y`` from GeoJSON text in ``json``, Polygon and MultiPolygon features alike: part 0 is the floor, others are stores.

    A feature of another kind gives no rows.
    """
    ring = "array<array<array<double>>>"
    kind = F.from_json("json", "features array<struct<geometry:struct<type:string,coordinates:string>>>")
    f = geo.select("site", F.posexplode(kind["features"]).alias("part", "f")).select("site", "part", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    many = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", ring))).when(F.col("type") == "MultiPolygon", F.from_json("c", f"array<{ring}>"))
    p = f.select("site", "part", F.posexplode(many).alias("polygon", "rings"))
    r = p.select("site", "part", "polygon", F.posexplode("rings").alias("ring", "points"))
    return r.select("site", "part", "polygon", "ring", F.posexplode("points").alias("i", "p")).select("site", "part", "polygon", "ring", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
