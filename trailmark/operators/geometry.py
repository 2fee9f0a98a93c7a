"""Points, segments and polygons as column expressions; spatial joins by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import cut


def bilinear_grid(corners: DataFrame, by: list[str], n_rows: str, n_cols: str) -> DataFrame:
    """Points between four corners (x00, y00, x01, y01, x10, y10, x11, y11), ``n_rows`` by ``n_cols`` of them."""
    g = corners.withColumn("i", F.explode(F.expr(f"sequence(0, {n_rows} - 1)"))).withColumn("j", F.explode(F.expr(f"sequence(0, {n_cols} - 1)")))
    u = F.coalesce(F.try_divide(F.col("i"), F.col(n_rows) - 1), F.lit(0.0))
    v = F.coalesce(F.try_divide(F.col("j"), F.col(n_cols) - 1), F.lit(0.0))
    at = lambda c: (1 - u) * ((1 - v) * F.col(f"{c}00") + v * F.col(f"{c}01")) + u * ((1 - v) * F.col(f"{c}10") + v * F.col(f"{c}11"))
    return g.select(*by, "i", "j", at("x").alias("x"), at("y").alias("y"))


def regular_grid(boxes: DataFrame, by: list[str], step: float) -> DataFrame:
    """Grid points of spacing ``step`` in boxes (x0, y0, x1, y1), edges included."""
    xs = F.expr(f"sequence(cast(ceil(x0 / {step}) as bigint), cast(floor(x1 / {step}) as bigint))")
    ys = F.expr(f"sequence(cast(ceil(y0 / {step}) as bigint), cast(floor(y1 / {step}) as bigint))")
    return boxes.withColumn("gx", F.explode(xs)).withColumn("gy", F.explode(ys)).select(*by, (F.col("gx") * step).alias("x"), (F.col("gy") * step).alias("y"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, an array of (x, y) whose last point joins the first: rays crossed are odd."""
    n = F.size(ring)

    def hit(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, n) + 1)
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + hit(i)) % 2 == 1


def _side(ax: Column, ay: Column, bx: Column, by_: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)


def crosses(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether segments ab and cd properly cross."""
    one = _side(*a, *b, *c) * _side(*a, *b, *d) < 0
    two = _side(*c, *d, *a) * _side(*c, *d, *b) < 0
    return one & two


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by_ - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def segment_cells(df: DataFrame, size: float, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Rows copied to each grid cell (cx, cy) their segment's box touches."""
    lo = lambda i: F.floor(F.least(a[i], b[i]) / size)
    hi = lambda i: F.floor(F.greatest(a[i], b[i]) / size)
    return df.withColumn("cx", F.explode(F.sequence(lo(0), hi(0)))).withColumn("cy", F.explode(F.sequence(lo(1), hi(1))))


def crossing_counts(moves: DataFrame, walls: DataFrame, by: list[str], key: str, size: float) -> DataFrame:
    """Per move (x0, y0, x1, y1) the walls (wall, u0, v0, u1, v1) it crosses; only segments of a common cell meet, equal ones as one with their number.

    A pair of several common cells counts in the first of them, so no pair is kept
    or shuffled: what leaves a task is a count for a move.
    """
    ends, sides = ["x0", "y0", "x1", "y1"], ["u0", "v0", "u1", "v1"]
    first = lambda a, b: F.floor(F.least(a, b) / size)
    m = segment_cells(moves.select(*by, *ends).distinct(), size, ("x0", "y0"), ("x1", "y1"))
    w = segment_cells(walls.groupBy(*by, *sides).agg(F.countDistinct("wall").alias("__n")), size, ("u0", "v0"), ("u1", "v1"))
    pts = [(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y1"), ("u0", "v0"), ("u1", "v1"))]
    here = (F.col("cx") == F.greatest(first("x0", "x1"), first("u0", "u1"))) & (F.col("cy") == F.greatest(first("y0", "y1"), first("v0", "v1")))
    met = m.join(w.hint("merge"), [*by, "cx", "cy"]).where(here & crosses(*pts))
    hit = met.groupBy(*by, *ends).agg(F.sum("__n").alias("crossings"))
    return moves.join(hit, [*by, *ends], "left").withColumn("crossings", F.coalesce("crossings", F.lit(0)))


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], radius: float) -> DataFrame:
    """Pairs of points (x, y) and (rx, ry) within ``radius``: right points are copied to the cells around them.

    The copies are never broadcast: a plan that counts the bytes before them would do so.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    l_ = left.withColumns({"cx": cell("x"), "cy": cell("y")})
    around = F.sequence(F.lit(-1), F.lit(1))
    r = right.withColumn("cx", F.explode(F.transform(around, lambda d: cell("rx") + d))).withColumn("cy", F.explode(F.transform(around, lambda d: cell("ry") + d)))
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    return l_.join(r.hint("merge"), [*by, "cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= radius).drop("cx", "cy")


def near_places(left: DataFrame, right: DataFrame, by: list[str], radius: float) -> DataFrame:
    """``near_pairs`` of places: points of equal coordinates are one, ``n`` right ones of them."""
    return near_pairs(left.select(*by, "x", "y").distinct(), right.groupBy(*by, "rx", "ry").agg(F.count(F.lit(1)).alias("n")), by, radius)


def least_distance(left: DataFrame, right: DataFrame, by: list[str], radius: float) -> DataFrame:
    """Left points with ``d``, the way to the nearest right one within ``radius``, else null."""
    near = near_places(left, right, by, radius).groupBy(*by, "x", "y").agg(F.min("distance").alias("d"))
    return left.join(near, [*by, "x", "y"], "left")


def crowd(points: DataFrame, by: list[str], radius: float) -> DataFrame:
    """Points with ``v``, the sum of 1 / max(1, distance) over all others within ``radius``, null without any."""
    near = near_places(points, points.select(*by, F.col("x").alias("rx"), F.col("y").alias("ry")), by, radius)
    others = F.col("n") - F.when(F.col("distance") == 0, 1).otherwise(0)
    dense = near.where(others > 0).groupBy(*by, "x", "y").agg(F.sum(others / F.greatest(F.lit(1.0), F.col("distance"))).alias("v"))
    return points.join(dense, [*by, "x", "y"], "left")


def knn(left: DataFrame, right: DataFrame, by: list[str], key: str, right_key: str, k: int, rounds: int = 3) -> DataFrame:
    """The k nearest right points of each left one within a group, ties by id; a point is not its own neighbour.

    Points of equal coordinates are one place, of whose right points the k + 1
    least ids can count: the k + 1 nearest of a place have the k of all its
    points. Places meet those of the grid cells around them, of a size that leaves
    a few times ``k`` in reach. Whoever has fewer than k + 1 points within the size
    of a cell (on the rim, in gaps) looks again in cells of four times the size,
    and again; each round has few places left. Those that ``rounds`` leave, as
    where a group has not ``k`` others, meet their whole group. Exact.
    """
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    distance = F.sqrt(dx * dx + dy * dy)
    place, need = [*by, "x", "y"], k + 1
    rest_of = [c for c in right.columns if c not in (*by, right_key, "rx", "ry")]
    least = Window.partitionBy(*by, "rx", "ry").orderBy(right_key)
    few = right.withColumn("__i", F.row_number().over(least)).where(F.col("__i") <= need)
    spots = cut(few.groupBy(*by, "rx", "ry").agg(F.collect_list(F.struct(right_key, *rest_of)).alias("__p")))
    w = Window.partitionBy(*place).orderBy(F.asc_nulls_last("distance"), right_key)
    side = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(1e-3))
    size = spots.groupBy(*by).agg((2 * F.sqrt(side("rx") * side("ry") * need / (F.count(F.lit(1)) * 3.14159))).alias("__r"))
    around = F.sequence(F.lit(-1), F.lit(1))

    def ranked(met: DataFrame) -> DataFrame:
        one = met.withColumn("__p", F.explode("__p")).select(*place, "rx", "ry", "__p.*", "distance")
        return one.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= need)

    def within(places: DataFrame, times: int) -> DataFrame:
        """Pairs within ``times`` the size of a cell, by cells of that size."""
        cell = lambda c: F.floor(F.col(c) / (F.col("__r") * times))
        l_ = places.join(size, by).withColumns({"__x": cell("x"), "__y": cell("y")})
        r = spots.join(size, by).withColumn("__x", F.explode(F.transform(around, lambda d: cell("rx") + d))).withColumn("__y", F.explode(F.transform(around, lambda d: cell("ry") + d))).drop("__r")
        # Neither side is broadcast: the copies to cells are many times the bytes that a plan expects.
        met = l_.join(r.hint("merge"), [*by, "__x", "__y"]).withColumn("distance", distance)
        return met.where(F.col("distance") <= F.col("__r") * times)

    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in place]
    found, rest = None, left.select(*place).distinct()
    for i in range(rounds):
        near = cut(ranked(within(rest, 4**i)))
        full = near.where(F.col("__i") == need).select(*place)
        done = near.join(full, place, "left_semi")
        found = done if found is None else found.unionByName(done)
        rest = cut(rest.join(full, same(rest, full), "left_anti"))
        if rest.isEmpty():
            break
    else:
        found = found.unionByName(ranked(rest.join(spots.hint("merge"), by).withColumn("distance", distance)))
    lists = found.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("__i", "distance", right_key, *rest_of, "rx", "ry"))).alias("__n"))
    lists = lists.withColumnsRenamed({c: f"__{c}" for c in place})
    at = left.join(lists.hint("merge"), [left[c].eqNullSafe(lists[f"__{c}"]) for c in place]).drop(*[f"__{c}" for c in place])
    others = F.slice(F.filter("__n", lambda n: n[right_key] != F.col(key)), 1, k)
    flat = at.withColumn("__n", others).select(*left.columns, F.posexplode("__n").alias("__i", "__n"))
    return flat.select(*left.columns, *[F.col(f"__n.{c}").alias(c) for c in (right_key, *rest_of, "rx", "ry", "distance")], (F.col("__i") + 1).alias("rank"))


def corners(ring: DataFrame, by: list[str], order: str, slack_deg: float) -> DataFrame:
    """Vertices where the direction turns by 90 or 270 degrees, give or take ``slack_deg``; the ring is closed."""
    w = Window.partitionBy(*by).orderBy(order)
    every = Window.partitionBy(*by)
    last = lambda c: F.max_by(c, order).over(every)
    first = lambda c: F.min_by(c, order).over(every)
    px, py = F.coalesce(F.lag("x").over(w), last("x")), F.coalesce(F.lag("y").over(w), last("y"))
    nx, ny = F.coalesce(F.lead("x").over(w), first("x")), F.coalesce(F.lead("y").over(w), first("y"))
    turn = F.pmod(F.degrees(F.atan2(ny - F.col("y"), nx - F.col("x")) - F.atan2(F.col("y") - py, F.col("x") - px)), F.lit(360.0))
    return ring.withColumn("turn", turn).where(F.col("turn").between(90 - slack_deg, 90 + slack_deg) | F.col("turn").between(270 - slack_deg, 270 + slack_deg))
