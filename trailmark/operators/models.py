"""Fitted models: emitters in space, boosted corrections out of fold, bags, signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import cut


def nelder_mead(f, x: np.ndarray, step: float, rounds: int = 300, tol: float = 1e-9) -> np.ndarray:
    """Least point of ``f`` from a simplex around ``x``."""
    s = np.vstack([x, x + step * np.eye(len(x))])
    v = np.array([f(p) for p in s])
    for _ in range(rounds):
        o = np.argsort(v, kind="stable")
        s, v = s[o], v[o]
        if v[-1] - v[0] < tol:
            break
        mid = np.add.reduce(s[:-1]) / len(x)

        def at(k: float) -> tuple[np.ndarray, float]:
            p = mid + k * (s[-1] - mid)  # noqa: B023
            return p, f(p)

        p, w = at(-1.0)
        if w < v[0]:
            q, u = at(-2.0)
            p, w = (q, u) if u < w else (p, w)
        elif w >= v[-2]:
            q, u = at(-0.5 if w < v[-1] else 0.5)
            if u < min(w, v[-1]):
                p, w = q, u
            else:
                s[1:] = s[0] + 0.5 * (s[1:] - s[0])
                v[1:] = [f(p) for p in s[1:]]
                continue
        s[-1], v[-1] = p, w
    return s[np.argmin(v)]


def fit_emitters(readings: DataFrame, by: list[str], scale: float = 20.0) -> DataFrame:
    """Place and power of each emitter (x, y, rssi rows): strength falls as squared distance over ``scale``.

    The fit uses every reading, equal ones as one row with their number; ``n`` counts
    them all and ``error`` is their mean absolute miss.
    """
    some = readings.groupBy(*by, "x", "y", "rssi").agg(F.count(F.lit(1)).alias("__n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rssi", "x", "y"], ascending=[False, True, True])
        x, y, s, n = *(pdf[c].to_numpy(float) for c in ("x", "y", "rssi")), pdf["__n"].to_numpy()
        miss = lambda p: float(np.average(np.abs(p[2] - ((x - p[0]) ** 2 + (y - p[1]) ** 2) / scale - s), weights=n))
        first = np.argmax(s)
        best = nelder_mead(miss, np.array([x[first], y[first], s.max()]), 2.0)
        row = {c: pdf[c].iloc[0] for c in by} | {"x": best[0], "y": best[1], "power": best[2], "error": miss(best), "n": int(n.sum())}
        return pd.DataFrame([row])

    kinds = dict(readings.dtypes)
    return some.groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", x double, y double, power double, error double, n long")


def locate_by_emitters(readings: DataFrame, emitters: DataFrame, by: list[str], scan: list[str], scale: float = 20.0) -> DataFrame:
    """Place of each scan from fitted emitters (emitter, x, y, power, error): the least sum of misses in strength, better emitters counting more.

    ``readings`` has emitter and rssi. The search begins at the strongest known
    emitter; a scan of no known emitter is absent. Scans are dealt to as many tasks
    as there are partitions: their rows are small and their searches long.
    """
    n = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = readings.join(emitters.select(*by, "emitter", F.col("x").alias("ex"), F.col("y").alias("ey"), "power", "error"), [*by, "emitter"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rssi", "emitter"], ascending=[False, True])
        x, y, power, rssi = (pdf[c].to_numpy(float) for c in ("ex", "ey", "power", "rssi"))
        weight = 1 / (1 + pdf["error"].to_numpy(float))
        whole = weight.sum()
        miss = lambda p: float((weight * np.abs(power - ((x - p[0]) ** 2 + (y - p[1]) ** 2) / scale - rssi)).sum() / whole)
        best = nelder_mead(miss, np.array([x[0], y[0]]), 2.0, rounds=120, tol=1e-5)
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in (*by, *scan)} | {"x": best[0], "y": best[1], "miss": miss(best), "emitters": len(pdf)}])

    kinds = dict(readings.dtypes)
    return known.repartition(n, *by, *scan).groupBy(*by, *scan).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*by, *scan)) + ", x double, y double, miss double, emitters int")


def speed_band(distances: DataFrame, by: list[str], near: int = 10, fade: float = 0.8, speed: float = 4.0, tolerance: float = 2.0, power: float = 1.5, weight: float = 3.0, first: int = 20) -> DataFrame:
    """Places of a trail's scans (scan in ms, pos, px, py, distance) that fit their fingerprints while the speed between them stays in a band.

    Each scan starts from the mean of its ``first`` nearest positions, weighted by
    the inverse fourth power of distance. The loss is the mean over scans of the
    distances at the ``near`` positions around the place, fading by ``fade`` a
    metre, and ``weight`` times the mean excess of the way to the next scan over
    what ``speed`` km/h plus or minus ``tolerance`` allows. A group is one trail.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="scan", columns="pos", values="distance").sort_index()
        place = pdf.drop_duplicates("pos").set_index("pos").loc[wide.columns, ["px", "py"]].to_numpy(float)
        d, hours = wide.to_numpy(float), np.diff(wide.index.to_numpy(float)) / 1000 / 3.6
        top = np.argsort(d, axis=1, kind="stable")[:, :first]
        low = np.take_along_axis(d, top, 1)
        w = ((low + 1e-5) / (low[:, :1] + 1e-5)) ** -4
        start = (place[top] * w[..., None]).sum(1) / w.sum(1)[:, None]

        def loss(flat: np.ndarray) -> float:
            at = flat.reshape(-1, 2)
            way = np.hypot(at[:, None, 0] - place[None, :, 0], at[:, None, 1] - place[None, :, 1])
            around = np.argsort(way, axis=1, kind="stable")[:, :near]
            share = fade ** np.take_along_axis(way, around, 1)
            signal = ((np.take_along_axis(d, around, 1) * share).sum(1) / share.sum(1)).mean()
            gone = np.hypot(*np.diff(at, axis=0).T)
            off = np.maximum(0, (speed - tolerance) * hours - gone) + np.maximum(0, gone - (speed + tolerance) * hours)
            return float(signal + (weight * (off**power).mean() if len(off) else 0.0))

        best = nelder_mead(loss, start.reshape(-1), 1.0, rounds=100 * start.size).reshape(-1, 2)
        if loss(best.reshape(-1)) > loss(start.reshape(-1)):
            best = start
        out = pd.DataFrame({"scan": wide.index, "x0": start[:, 0], "y0": start[:, 1], "x": best[:, 0], "y": best[:, 1], "loss0": loss(start.reshape(-1)), "loss": loss(best.reshape(-1))})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "scan", "x0", "y0", "x", "y", "loss0", "loss"]]

    kinds = dict(distances.dtypes)
    return distances.groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*by, "scan")) + ", x0 double, y0 double, x double, y double, loss0 double, loss double")


def out_of_fold(df: DataFrame, features: list[str], target: str, fold: str, folds: int, **options) -> DataFrame:
    """``df`` with ``predicted``: gradient-boosted trees fitted on the other folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = VectorAssembler(inputCols=features, outputCol="__f", handleInvalid="keep").transform(df)
    done = None
    for k in range(folds):
        model = GBTRegressor(featuresCol="__f", labelCol=target, predictionCol="predicted", seed=k, **({"maxIter": 10, "maxDepth": 3} | options)).fit(ready.where(F.col(fold) != k))
        part = model.transform(ready.where(F.col(fold) == k)).drop("__f")
        done = part if done is None else done.unionByName(part)
    return done


def bag(df: DataFrame, by: list[str], predicted: list[str]) -> DataFrame:
    """Mean prediction over several fits of the same rows."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in predicted])


def stack_sections(df: DataFrame, by: list[str], targets: dict[str, str]) -> DataFrame:
    """One row per section from columns first/middle/last: ``section`` and ``value``."""
    return df.unpivot(by, list(targets), "section", "value").withColumn("section", F.coalesce(*[F.when(F.col("section") == c, name) for c, name in targets.items()]))


def nearest_signature(query: DataFrame, reference: DataFrame, by: list[str], key: str, other: str, columns: list[str]) -> DataFrame:
    """Of each query window the reference window of least mean standardised difference in ``columns``.

    Deviations come from the reference of each group, not under a tenth of their
    mean over columns. Equal windows are one; a group's queries meet its references
    in as many slices as there are partitions, so that a large group is no single
    task. Windows are written once: sums taken again in another order differ in
    their last bits, and a window would not find its own match.
    """
    query, reference = cut(query.select(*by, key, *columns)), cut(reference.select(*by, other, *columns))
    n = int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = reference.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    low = sum((F.col(f"__s_{c}") for c in columns), F.lit(0.0)) / len(columns) / 10
    r = reference.groupBy(*by, *[F.col(c).alias(f"__r_{c}") for c in columns]).agg(F.min(other).alias(other)).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    q = query.join(spread, by).withColumn("__s", F.pmod(F.xxhash64(*by, *columns), F.lit(n)).cast("int"))
    asked = q.select(*by, "__s", *columns, *[f"__s_{c}" for c in columns]).distinct()
    j = asked.repartition(n, *by, "__s").join(r.repartition(n, *by, "__s").hint("merge"), [*by, "__s"])
    gap = sum((F.coalesce(F.try_divide(F.abs(F.col(c) - F.col(f"__r_{c}")), F.greatest(F.col(f"__s_{c}"), low)), F.lit(0.0)) for c in columns), F.lit(0.0)) / len(columns)
    # Nine decimals, so that copies whose means differ in their last bits tie and the least id wins.
    gap = F.round(gap, 9)
    best = j.groupBy(*by, "__s", *columns).agg(F.min_by(other, F.struct(gap, F.col(other))).alias(other), F.min(gap).alias("difference")).drop("__s")
    best = best.toDF(*by, *[f"__q_{c}" for c in columns], other, "difference")
    return query.join(best, [query[c] == best[c] for c in by] + [query[c].eqNullSafe(best[f"__q_{c}"]) for c in columns]).select(*[query[c] for c in by], key, other, "difference")
