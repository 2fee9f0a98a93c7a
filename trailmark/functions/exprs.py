"""Column builders: angles, rotation, clamps, decays, keys, labels, hashed chance."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def wrap_angle(a: Column) -> Column:
    """Angle in (-pi, pi]: -pi itself becomes pi."""
    return a - F.lit(TWO_PI) * F.ceil((a - F.lit(math.pi)) / F.lit(TWO_PI))


def circular_diff(a: Column, b: Column) -> Column:
    """Unsigned difference of two angles within [0, pi]."""
    d = F.abs(wrap_angle(a - b))
    return F.least(d, F.lit(TWO_PI) - d)


def azimuth(dx: Column, dy: Column) -> Column:
    """Direction from north, clockwise, in [0, 2 pi)."""
    return F.pmod(F.atan2(dx, dy), F.lit(TWO_PI))


def in_box(x: Column, y: Column, x_min: float, x_max: float, y_min: float, y_max: float) -> Column:
    """Whether a point is inside a box, its sides excluded."""
    return (x > x_min) & (x < x_max) & (y > y_min) & (y < y_max)


def median_or(value: Column, default: float) -> Column:
    """Aggregate: the median of two or more values, else ``default``."""
    return F.when(F.count(value) > 1, F.median(value)).otherwise(default)


def rotate(dx: Column, dy: Column, heading: Column) -> tuple[Column, Column]:
    """A vector in the frame whose first axis points along ``heading``."""
    c, s = F.cos(heading), F.sin(heading)
    return dx * c + dy * s, dy * c - dx * s


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), x))


def decay(delay_ms: Column, base: float, grace_ms: float = 1000.0) -> Column:
    """``base`` to the power of the seconds of delay beyond the grace period."""
    return F.pow(F.lit(base), (F.greatest(F.lit(grace_ms), delay_ms.cast("double")) - F.lit(grace_ms)) / 1000.0)


def signed_log10(x: Column) -> Column:
    """sign(x) * log10(abs(x)); null at zero."""
    return F.signum(x) * F.log10(F.nullif(F.abs(x.cast("double")), F.lit(0.0)))


def euclid(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def vector_l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: float = 1e-9) -> Column:
    """Cosine similarity with guarded norms."""
    return vector_dot(a, b) / ((F.sqrt(vector_dot(a, a)) + guard) * (F.sqrt(vector_dot(b, b)) + guard))


def key_of(site: Column, path: Column, ts: Column, width: int = 13) -> Column:
    """``site_path_timestamp`` with a zero-padded time."""
    return F.concat_ws("_", site, path, F.lpad(ts.cast("string"), width, "0"))


def key_parts(key: Column) -> dict[str, Column]:
    return {"site": F.split_part(key, F.lit("_"), F.lit(1)), "path": F.split_part(key, F.lit("_"), F.lit(2)), "ts": F.split_part(key, F.lit("_"), F.lit(3)).cast("bigint")}


def label_to_int(label: Column, first: Mapping[str, int], second: Mapping[str, int]) -> Column:
    """The first map's value, else the second's, else null."""
    both = [F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (first, second)]
    return F.coalesce(F.try_element_at(both[0], label), F.try_element_at(both[1], label))


def stem(path: Column) -> Column:
    """File name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def hash_unit(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) from md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def fold_of(key: Column, folds: int, seed: str = "") -> Column:
    n = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(n, F.lit(folds)).cast("int")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000)


def membership_bits(score: Column, n: int) -> Column:
    """Decode a sum of 2**i weights to an array of n flags, least first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(score.cast("bigint"), i).cast("int") == 1)
