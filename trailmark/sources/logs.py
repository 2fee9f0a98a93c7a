"""Sensor logs: tab-separated records ``time, TYPE_x, values`` under ``#`` header and footer lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = r"(\d{13}\tTYPE_)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every file below ``path`` with the file it comes from."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))


def repair(lines: DataFrame) -> DataFrame:
    """``ts, tag, values`` of each record; a line that holds several is cut before each 13-digit time.

    Blank and ``#`` lines are dropped. A line without a tag gives a row with a
    null tag, for quarantine.
    """
    rest = [c for c in lines.columns if c != "value"]
    body = lines.where("trim(value) != '' and not startswith(value, '#')")
    cut = body.withColumn("rec", F.explode(F.split(F.regexp_replace("value", STAMP, "\n$1"), "\n"))).where("rec != ''")
    f = F.split("rec", "\t")
    tagged = F.regexp_count("rec", F.lit("TYPE_")) > 0
    return cut.select(*rest, F.when(tagged, f[0]).try_cast("bigint").alias("ts"), F.when(tagged, F.get(f, F.lit(1))).alias("tag"), F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))).alias("values"), F.when(~tagged, F.col("rec")).alias("corrupt"))


def typed(records: DataFrame, tag: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Records of one tag as typed columns; fields a short record lacks are null."""
    rest = [c for c in records.columns if c not in ("tag", "values", "corrupt")]
    return records.where(F.col("tag") == tag).select(*rest, *[F.get("values", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def header(lines: DataFrame) -> DataFrame:
    """``file, meta``: the key:value pairs of a file's ``#`` lines as a map, later ones first."""
    pairs = F.filter(F.split(F.regexp_replace("value", r"^#\s*", ""), "\t"), lambda x: x.contains(":"))
    kv = lines.where("startswith(value, '#')").select("file", F.explode(pairs).alias("p"))
    one = kv.groupBy("file", F.substring_index("p", ":", 1).alias("k")).agg(F.max(F.expr("substring(p, instr(p, ':') + 1)")).alias("v"))
    return one.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))


def file_summary(lines: DataFrame) -> DataFrame:
    """Per file: start and end time, whether its footer is there, rows and rows by kind, first and last anchor."""
    rec = repair(lines)
    meta = header(lines)
    anchor = F.col("tag") == "TYPE_WAYPOINT"
    place = F.struct(F.get("values", F.lit(0)).try_cast("double").alias("x"), F.get("values", F.lit(1)).try_cast("double").alias("y"))
    per = rec.groupBy("file").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.max("ts").alias("last_time"),
        F.count_if(anchor).alias("num_waypoints"),
        F.count_if(F.col("tag") == "TYPE_WIFI").alias("num_wifi"),
        F.count_if(F.col("tag") == "TYPE_BEACON").alias("num_beacon"),
        F.min_by(F.when(anchor, place), F.when(anchor, F.col("ts"))).alias("first_waypoint"),
        F.max_by(F.when(anchor, place), F.when(anchor, F.col("ts"))).alias("last_waypoint"),
    )
    m = lambda k: F.try_element_at("meta", F.lit(k)).try_cast("bigint")
    return per.join(meta, "file", "left").select("file", m("startTime").alias("start_time"), F.coalesce(m("endTime"), F.col("last_time")).alias("end_time"), m("endTime").isNotNull().alias("complete"), "num_rows", "num_waypoints", "num_wifi", "num_beacon", "first_waypoint", "last_waypoint")


def floor_outline(geo: DataFrame) -> DataFrame:
    """``site, part, ring, i, x, y`` from GeoJSON text in ``json``: feature 0 is the outline, the others are stores."""
    kind = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    f = geo.select("site", F.posexplode(F.from_json("json", kind)["features"]).alias("part", "f"))
    r = f.select("site", "part", F.posexplode("f.geometry.coordinates").alias("ring", "c"))
    p = r.select("site", "part", "ring", F.posexplode("c").alias("i", "p"))
    return p.select("site", "part", "ring", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
