"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target over its size says how many copies of each of its rows the mix
wants: a whole part that all rows get, and a fraction that rows get with that
probability. Rounding pairs two fractional rows and moves words from one to the
other, by chance but keeping both expectations, until one is whole; the other
meets the next. Rows are paired within blocks, what each block leaves is paired
in blocks of the next level, and so on up a tree. A source ends with one
fractional row at most, so its words miss the target by half a row at most.
Chance is a hash of the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, by_place, cut, meet, table

BLOCK = 64
CAP = 3.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Rows (group, source, source_size), one a source, with their target.

    Sources in order of their bytes (which is that of code points), null last,
    weigh 1, 2, 3, 1, ... of the total; none gets more than ``cap`` times its
    size. What is above goes to the others by weight, so there is a level L with
    target = least(cap * size, L * weight): sources are capped in order of
    cap * size / weight, and L follows from running sums.
    """
    w = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", ((F.col("n") - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), "n")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(every)).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.col("open"))
    # The first source that its level does not cap, and all after it, share that level.
    first = F.first(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return w.withColumn("at", first).select("group", "source", "source_size", F.coalesce(F.least(F.col("at") * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def _unit(*of: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double")) * F.lit(2.0**-53)


def _fold(rows: Column, seed: int) -> Column:
    """Pair the rows of a block in order: struct(open, done), at most one row open."""
    row = "struct<id:bigint,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(row).alias("open"), F.array().cast(f"array<{row}>").alias("done"))

    def settle(id_: Column, size: Column, p: Column) -> Column:
        """Snap to a whole number what rounding error leaves beside one."""
        return F.struct(id_.alias("id"), size.alias("size"), F.when(p * size < 1e-6, 0.0).when((1 - p) * size < 1e-6, 1.0).otherwise(p).alias("p"))

    def meet(state: Column, x: Column) -> Column:
        o = state["open"]
        up = F.least((1 - o["p"]) * o["size"], x["p"] * x["size"])
        down = F.least(o["p"] * o["size"], (1 - x["p"]) * x["size"])
        gain = F.when(_unit(F.lit(seed), o["id"], x["id"]) * (up + down) < down, up).otherwise(-down)
        a = settle(o["id"], o["size"], o["p"] + gain / o["size"])
        b = settle(x["id"], x["size"], x["p"] - gain / x["size"])
        whole = lambda r: (r["p"] == 0.0) | (r["p"] == 1.0)
        both = F.struct(a.alias("a"), b.alias("b"))
        keep = F.transform(F.array(both), lambda t: F.struct(F.when(~whole(t["a"]), t["a"]).when(~whole(t["b"]), t["b"]).alias("open"), F.concat(state["done"], F.filter(F.array(t["a"], t["b"]), whole)).alias("done")))
        return F.when(o.isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(keep[0])

    return F.aggregate(rows, start, meet)


def _settled(rows: Column, seed: int) -> Column:
    """The rows of one array, largest first, settled one after another; at most one stays open.

    The largest open row takes words from all the smaller ones, or gives them
    words, each a share p * (1 - p) * size of what moves: as many as make it
    whole, or fewer if one of the others becomes whole before. The chances of
    both ways keep every expectation. So a large row is settled against the sum
    of the small ones, and what is open last is small. Where these have not the
    words to make it whole one way but have the room the other way, it goes that
    way for certain: a row too large for its source's target is not taken by chance
    at the price of the target.
    """
    is_open = lambda r: (r["p"] > 0.0) & (r["p"] < 1.0)

    def settle(r: Column, p: Column) -> Column:
        return F.struct(r["id"].alias("id"), r["size"].alias("size"), F.when(p * r["size"] < 1e-6, 0.0).when((1 - p) * r["size"] < 1e-6, 1.0).otherwise(p).alias("p"))

    def step(state: Column, k: Column) -> Column:
        live = F.filter(state, is_open)
        one, rest = F.get(live, F.lit(0)), F.slice(live, F.lit(2), F.greatest(F.size(live) - 1, F.lit(0)))
        weight = F.aggregate(rest, F.lit(0.0), lambda s, r: s + r["p"] * (1 - r["p"]) * r["size"])
        p = F.transform(rest, lambda r: r["p"])
        up = F.least((1 - one["p"]) * one["size"], weight / (1 - F.array_min(p)))
        down = F.least(one["p"] * one["size"], weight / F.array_max(p))
        # What the others have to give, and what they have room for.
        words = F.aggregate(rest, F.lit(0.0), lambda s, r: s + r["p"] * r["size"]) >= (1 - one["p"]) * one["size"]
        room = F.aggregate(rest, F.lit(0.0), lambda s, r: s + (1 - r["p"]) * r["size"]) >= one["p"] * one["size"]
        known = F.array(F.struct(one.alias("one"), weight.alias("weight"), up.alias("up"), down.alias("down"), words.alias("words"), room.alias("room"), F.size(live).alias("n")))

        def move(b: Column) -> Column:
            chance = _unit(F.lit(seed), b["one"]["id"], k) * (b["up"] + b["down"]) < b["down"]
            gain = F.when(F.when(b["words"] == b["room"], chance).otherwise(b["words"]), b["up"]).otherwise(-b["down"])
            given = F.transform(F.array(gain), lambda g: F.transform(state, lambda r: F.when(r["id"] == b["one"]["id"], settle(r, r["p"] + g / r["size"])).when(is_open(r), settle(r, r["p"] - g * r["p"] * (1 - r["p"]) / b["weight"])).otherwise(r)))
            return F.when(b["n"] < 2, state).otherwise(given[0])

        return F.transform(known, move)[0]

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), rows, step)


def _giants(rows: Column, p: Column, total: Column, seed: int) -> Column:
    """Rows of an array, largest first, settled one after another against all others of their group, which share the probability ``p``.

    A row that becomes whole moves the words it takes or gives evenly over the
    ``rest`` of the group, so one number tells what is left to each of them. Returns
    struct(p, rest, rows): rows with their copy, null where neither way is open.
    """
    row = "struct<id:bigint,copy:int>"
    start = F.struct(p.alias("p"), total.cast("double").alias("rest"), F.array().cast(f"array<{row}>").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        rest, q = s["rest"] - x["size"], s["p"]
        need, give = (1 - q) * x["size"], q * x["size"]
        up, down = q * rest >= need, (1 - q) * rest >= give
        copy = F.when(up & down, (_unit(F.lit(seed), x["id"]) < q).cast("int")).when(up, 1).when(down, 0)
        part = lambda words: F.coalesce(F.try_divide(words, rest), F.lit(0.0))
        new = F.when(copy == 1, q - part(need)).when(copy == 0, q + part(give)).otherwise(q)
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), new)).alias("p"), rest.alias("rest"), F.concat(s["rows"], F.array(F.struct(x["id"].alias("id"), copy.alias("copy")))).alias("rows"))

    return F.aggregate(rows, start, step)


def pivotal(rows: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``group, id, copy`` (0 or 1) for ``rows`` (group, id, size, p): 1 with probability p, words kept by group.

    Ids are unique in a group. Sizes of 0 and probabilities of 0 or 1 need no
    rounding. A group's smallest rows wait for the top of the tree, where large
    ones are settled against the sum of all smaller ones; so what is open last, and
    goes to the nearer whole number, is a small row unless the others together
    cannot make up for a large one. Probabilities that are as good as whole are so.
    """
    whole = "p * size < 1e-6 or (1 - p) * size < 1e-6"
    settled = rows.where(whole).select("group", "id", (F.col("p") >= 1).cast("int").alias("copy"))
    # Where a group's rows share one probability, the few that hold over a block's share of its words each are settled before all others.
    left = cut(rows.where(f"not ({whole})").select("group", "id", "size", "p"))
    stats = cut(left.groupBy("group").agg(F.sum("size").alias("total"), F.min("p").alias("low"), F.max("p").alias("high")))
    groups = stats.count()
    told = meet(left, stats, "group", groups, "id")
    giant = (F.col("low") == F.col("high")) & (F.col("size") * block > F.col("total"))
    listed = told.where(giant).groupBy("group").agg(F.first("p").alias("p"), F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("size", "id")), asc=False).alias("r"))
    solved = cut(listed.select("group", _giants(F.col("r"), F.col("p"), F.col("total"), seed).alias("s")))
    settled = settled.unionByName(solved.select("group", F.explode("s.rows").alias("d")).where("d.copy is not null").select("group", "d.id", "d.copy"))
    now = solved.select("group", F.col("s.p").alias("now"))
    others = meet(told.where(~giant), stats.select("group").join(now, "group", "left"), "group", groups, "id").select("group", "id", "size", F.coalesce("now", "p").alias("p"))
    stay = told.where(giant).join(solved.select("group", F.explode("s.rows").alias("d")).where("d.copy is null").select("group", "d.id"), ["group", "id"]).select("group", "id", "size", "p")
    rows = cut(others.unionByName(stay))
    settled = settled.unionByName(rows.where(whole).select("group", "id", (F.col("p") >= 0.5).cast("int").alias("copy")))
    rank = Window.partitionBy("group").orderBy("size", "id")
    left = rows.where(f"not ({whole})").select("group", "id", "size", "p")
    small = left.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= block).select("group", "id", F.lit(True).alias("held"))
    left = cut(left.join(small, ["group", "id"], "left").select("group", "id", "size", "p", F.coalesce("held", F.lit(False)).alias("held")))

    def fold(spread: DataFrame, keys: list[str], salt: int) -> DataFrame:
        """Large rows first: what stays open meets smaller ones until it is whole."""
        made = spread.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("size", "id", "p")), asc=False).alias("r"))
        order = F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["p"].alias("p")))
        return cut(made.select("group", _fold(order, salt).alias("s")).select("group", "s.open", "s.done"))

    def finished(done: DataFrame) -> DataFrame:
        return done.select("group", F.explode("done").alias("d")).select("group", "d.id", F.col("d.p").cast("int").alias("copy"))

    held, left, level = left.where("held").drop("held"), left.where("not held").drop("held"), 0
    while True:
        counts = left.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        most, groups = counts.agg(F.max("blocks"), F.count(F.lit(1))).first()
        if not groups or most <= 1:
            break
        counted = meet(left, counts, "group", groups, "id")
        spread = counted.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.col("blocks")))
        n = Window.partitionBy("group", "slot").orderBy("id")
        spread = spread.where("blocks > 1").repartition("group", "slot").withColumn("part", F.floor((F.row_number().over(n) - 1) / (4 * block)))
        done = fold(spread, ["group", "slot", "part"], seed + level)
        settled = settled.unionByName(finished(done))
        few = counted.where("blocks <= 1").select(*left.columns)
        left = few.unionByName(done.where("open is not null").select("group", "open.id", "open.size", "open.p"))
        level += 1
    made = left.unionByName(held).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("size", "id", "p")), asc=False).alias("r"))
    order = F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["p"].alias("p")))
    top = made.select("group", F.explode(_settled(order, seed + level)).alias("d"))
    return settled.unionByName(top.select("group", "d.id", (F.col("d.p") >= 0.5).cast("int").alias("copy")))


def _numbered(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """Rows of one id and text told apart by their number among equals, by source, in ``__k``."""
    rows = docs.withColumns({"__d": F.col(doc_id).cast("string"), "__t": F.xxhash64(F.col(text).cast("string"))})
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("__d", "__t").orderBy(F.col(source).cast("string").asc_nulls_first())))


def decide(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: float = CAP, seed: int = 7) -> DataFrame:
    """What the mix takes of every row, without its text: doc_id, source, size, source_size, target, copies, taken, and the row's ``__d, __t, __k``."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = _numbered(slim.withColumn("size", word_count(F.col("text"))), "text", "doc_id", "source").drop("text")
    rows = cut(rows.withColumns({"group": F.xxhash64(F.lit(1), F.col("source")), "id": F.xxhash64(F.lit(seed), "__d", "__t", "__k")}))
    plan = cut(targets(rows.groupBy("group", "source").agg(F.sum("size").alias("source_size")), cap))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    planned = meet(rows, plan.select("group", "source_size", "target", rate.alias("rate")), "group", plan.count(), "id")
    chosen = pivotal(planned.select("group", "id", "size", (F.col("rate") - F.floor("rate")).alias("p")), seed)
    copies = (F.floor("rate") + F.col("copy")).cast("long")
    return planned.join(chosen, ["group", "id"]).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "__d", "__t", "__k")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: float = CAP, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken.

    Size is the number of words; a null text has none. ``copies`` is how often
    the mix repeats the row and ``taken`` size times that. A null source is a
    source; rows without words are taken as their source's rate says and count
    nothing. Rows of one id and text are told apart by number. Columns with the
    names of the results are replaced, others may have any name; an empty table
    gives no rows. A long text is a row like any other, whole or not taken.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    rows, at, kept = by_place(docs, (text, source, doc_id), set(new))
    rows = _numbered(rows, at[text], at[doc_id], at[source])
    got = decide(docs, text, source, doc_id, cap, seed).drop("doc_id", "source").withColumnRenamed("__d", "__e")
    out = rows.join(got, rows["__d"].eqNullSafe(got["__e"]) & (rows["__t"] == got["__t"]) & (rows["__k"] == got["__k"]))
    return out.select(*[rows[at[c]] for c in kept], *new).toDF(*kept, *new)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each.

    A null text has none, a null source is a source; see ``mix``.
    """
    return decide(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
