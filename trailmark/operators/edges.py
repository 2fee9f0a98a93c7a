"""Edge records: of every trail the one that ended before it and the one that began after it, and whether they tell where it starts and ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import dissimilarity, edge_similarity

#: Candidates tried a side, dissimilarity below which one is relied on, and a reading's greatest age among an edge's.
TRIES = 5
RELIABLE = 12.0
FRESH_MS = 10_000
DAY_MS = 86_400_000
#: Fixed format: the columns of a result in order.
_SIDE = ("can_use_{0}", "delay_{0}", "{0}_shared_fraction", "{0}_mean_dist", "{0}_dissimilarity", "{0}_mode", "{0}_fn", "{0}_device_id", "{0}_device_id_drift", "{0}_device_id_merged")
RESULT = (
    "site", "fn", "num_waypoints",
    *(c.format("preceding") for c in _SIDE), "preceding_match_offset_fn", "preceding_floor", "preceding_x", "preceding_y", "first_x", "first_y",
    *(c.format("succeeding") for c in _SIDE), "succeeding_floor", "succeeding_match_offset_fn", "succeeding_x", "succeeding_y", "last_x", "last_y",
    "reliable_preceding", "reliable_succeeding", "reliable_preceding_device_id", "reliable_succeeding_device_id", "actual_device_id", "actual_device_id_drift", "actual_device_id_merged",
    "reliable_preceding_floor", "reliable_succeeding_floor", "actual_floor",
)


def edge_readings(readings: DataFrame, last: bool) -> DataFrame:
    """Fresh readings of each trail's last (or first) scan: key, emitter, rssi.

    ``readings`` has site, fn, scan (its time), heard (when the emitter was heard),
    emitter and rssi. Of an emitter heard twice in the scan the earlier row counts.
    """
    edge = readings.groupBy("site", "fn").agg((F.max if last else F.min)("scan").alias("scan"))
    own = readings.join(edge.toDF("site", "fn", "scan"), ["site", "fn", "scan"])
    fresh = own.withColumn("newest", F.max("heard").over(Window.partitionBy("site", "fn"))).where(F.col("newest") - F.col("heard") <= FRESH_MS)
    key = F.struct("site", "fn").alias("key")
    return fresh.groupBy(key, "emitter").agg(F.min_by("rssi", F.struct("heard", "rssi")).alias("rssi"))


def _numbered(trails: DataFrame, time: str, last_first: bool) -> DataFrame:
    """``place`` of each trail in its site by ``time``: places within a day, from where the days before end; so a site's days are apart."""
    day = F.floor(F.col(time) / DAY_MS)
    t = trails.select("site", "fn", F.col(time).alias("at"), day.alias("day"))
    tie = F.desc("fn") if last_first else F.asc("fn")
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("site", "day").orderBy("at", tie)))
    return t.join(_offsets(t), ["site", "day"]).select("site", "fn", (F.col("n") + F.col("from")).alias("place"))


def _offsets(t: DataFrame) -> DataFrame:
    before = Window.partitionBy("site").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return t.groupBy("site", "day").agg(F.count(F.lit(1)).alias("c")).select("site", "day", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("from"))


def _counted(asked: DataFrame, time: str, others: DataFrame, other_time: str, strict: bool) -> DataFrame:
    """``n``: how many of a site's others are before ``time`` (``strict``: not at it either), by days as in ``_numbered``."""
    row = lambda df, c, kind, fn: df.select("site", fn.alias("fn"), F.col(c).alias("at"), F.floor(F.col(c) / DAY_MS).alias("day"), F.lit(kind).alias("kind"))
    # At equal times the asked one comes first where those at it don't count.
    both = row(asked, time, 0 if strict else 2, F.col("fn")).unionByName(row(others, other_time, 1, F.lit(None).cast("string")))
    w = Window.partitionBy("site", "day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("n", F.sum((F.col("kind") == 1).cast("long")).over(w)).where("kind != 1")
    days = both.groupBy("site", "day").agg(F.sum((F.col("kind") == 1).cast("long")).alias("c"))
    before = Window.partitionBy("site").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offset = days.select("site", "day", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("from"))
    return seen.join(offset, ["site", "day"]).select("site", "fn", (F.col("n") + F.col("from")).alias("n"))


def candidates(trails: DataFrame, asked: DataFrame, before: bool, tries: int = TRIES) -> DataFrame:
    """``site, fn, other, rank``: the ``tries`` trails that ended last before a trail began (or began first after it ended), nearest first.

    Where the trail's place on a known path of devices is given (path_device of 0 or
    more), only its neighbour on the path counts, if of the same device.
    """
    free, bound = asked.where("path_device is null or path_device < 0"), asked.where("path_device >= 0")
    if before:
        n = _counted(free, "start_time", trails, "end_time", True)
        ranked = _numbered(trails, "end_time", True).toDF("site", "other", "place")
        tried = n.withColumn("place", F.explode(F.sequence(F.col("n"), F.greatest(F.col("n") - tries + 1, F.lit(1)), F.lit(-1)))).where("n > 0")
        rank = F.col("n") - F.col("place")
    else:
        n = _counted(free, "end_time", trails, "start_time", False)
        ranked = _numbered(trails, "start_time", False).toDF("site", "other", "place")
        tried = n.withColumn("place", F.explode(F.sequence(F.col("n") + 1, F.col("n") + tries)))
        rank = F.col("place") - F.col("n") - 1
    near = tried.join(ranked, ["site", "place"]).select("site", "fn", "other", rank.cast("int").alias("rank"))
    step = -1 if before else 1
    path = trails.where("path_device >= 0").select("site", F.col("fn").alias("other"), F.col("path_order").alias("place"), F.col("path_device").alias("d"))
    told = bound.select("site", "fn", "path_device", (F.col("path_order") + step).alias("place")).join(path, ["site", "place"]).where("d = path_device")
    return near.unionByName(told.select("site", "fn", "other", F.lit(0).alias("rank")))


def _side(trails: DataFrame, asked: DataFrame, pairs: DataFrame, similar: DataFrame, before: bool, valid: bool, reliable: float) -> DataFrame:
    """The candidate chosen on one side: the first to be relied on whose floor no earlier one had, else the nearest."""
    side = "preceding" if before else "succeeding"
    other = trails.select("site", F.col("fn").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("start_time", "end_time", "mode", "floor", "device_id", "device_id_drift", "device_id_merged", "first_x", "first_y", "last_x", "last_y", "leak")])
    own = asked.select("site", "fn", "start_time", "end_time", "device_id")
    j = pairs.join(own, ["site", "fn"]).join(other, ["site", "other"]).join(similar, ["site", "fn", "other"])
    delay = F.col("start_time") - F.col("o_end_time") if before else F.col("o_start_time") - F.col("end_time")
    leaked = F.coalesce(F.col("o_leak") == ("end" if before else "start"), F.lit(False))
    use = ((F.col("o_mode") != "test") | leaked) & (F.lit(not valid) | (F.col("o_mode") != "valid"))
    j = j.withColumns({"delay": delay, "use": use}).withColumn("dis", dissimilarity(F.col("fraction"), F.col("mean"), F.col("delay")))
    j = j.withColumn("ok", F.coalesce(F.col("use") & (F.col("dis") < reliable) & (F.col("o_device_id") == F.col("device_id")), F.lit(False)))
    earlier = Window.partitionBy("site", "fn").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("new", F.col("ok") & ~F.coalesce(F.array_contains(F.collect_set("o_floor").over(earlier), F.col("o_floor")), F.lit(False)))
    x, y = ("o_last_x", "o_last_y") if before else ("o_first_x", "o_first_y")
    cols = {
        f"can_use_{side}": "use", f"delay_{side}": "delay", f"{side}_shared_fraction": "fraction", f"{side}_mean_dist": "mean", f"{side}_dissimilarity": "dis", f"{side}_mode": "o_mode", f"{side}_fn": "other",
        f"{side}_device_id": "o_device_id", f"{side}_device_id_drift": "o_device_id_drift", f"{side}_device_id_merged": "o_device_id_merged", f"{side}_match_offset_fn": "rank", f"{side}_floor": "o_floor",
    }
    told = lambda c: F.when(F.col("ok"), F.col(c))
    place = {f"{side}_x": F.when(F.col("use"), F.col(x)), f"{side}_y": F.when(F.col("use"), F.col(y)), f"reliable_{side}": F.col("ok"), f"reliable_{side}_device_id": told("o_device_id"), f"reliable_{side}_floor": told("o_floor")}
    one = F.struct(*[F.col(c).alias(n) for n, c in cols.items()], *[c.alias(n) for n, c in place.items()])
    return j.groupBy("site", "fn").agg(F.min_by(one, F.struct(~F.col("new"), F.col("rank"))).alias(side))


def edge_records(trails: DataFrame, readings: DataFrame, valid: bool = False, tries: int = TRIES, reliable: float = RELIABLE) -> DataFrame:
    """The columns ``RESULT`` of every trail of mode valid (``valid``) or test.

    ``trails``: site, fn, mode (train, valid, test), start_time, end_time (ms), floor,
    num_waypoints, first_x, first_y, last_x, last_y, device_id, device_id_drift,
    device_id_merged, path_order and path_device (null: not on a path), leak (start,
    end or null: a test trail's end that is known all the same). ``readings`` as in
    ``edge_readings``. A side without a candidate has -1 for numbers, "None" for the mode and
    nulls else. Names are those of a site; ties of time go by name.
    """
    asked = trails.where(F.col("mode") == ("valid" if valid else "test"))
    first, last = edge_readings(readings, False), edge_readings(readings, True)
    sides = []
    for before in (True, False):
        pairs = candidates(trails, asked, before, tries)
        key = lambda c: F.struct("site", F.col(c).alias("fn"))
        keyed = pairs.select("site", "fn", "other", key("other" if before else "fn").alias("a"), key("fn" if before else "other").alias("b"))
        similar = edge_similarity(last, first, keyed, "a", "b", "emitter", "rssi").select("site", "fn", "other", "fraction", "mean")
        sides.append(_side(trails, asked, pairs, similar, before, valid, reliable))
    own = asked.select("site", "fn", "num_waypoints", "first_x", "first_y", "last_x", "last_y", *[F.col(c).alias(f"actual_{c}") for c in ("device_id", "device_id_drift", "device_id_merged", "floor")])
    out = own.join(sides[0], ["site", "fn"], "left").join(sides[1], ["site", "fn"], "left")
    none: dict[str, Column] = {}
    for s in ("preceding", "succeeding"):
        none |= {f"can_use_{s}": F.lit(False), f"delay_{s}": F.lit(-1), f"{s}_shared_fraction": F.lit(-1.0), f"{s}_mean_dist": F.lit(-1.0), f"{s}_mode": F.lit("None"), f"reliable_{s}": F.lit(False)}
    plain = {*own.columns}
    of = lambda c: F.col(c) if c in plain else F.col(f"{'preceding' if 'preceding' in c else 'succeeding'}.{c}")
    return out.select(*[(F.coalesce(of(c), none[c]) if c in none else of(c)).alias(c) for c in RESULT])
