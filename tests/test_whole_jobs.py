"""Registered queries over whole tables: small fixtures against brute force."""

import datetime as dt
from collections import Counter, defaultdict

import numpy as np
import pytest

from trailmark import plans

Q = plans.all_queries()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Orders, customers and line items whose keys lie on both sides of the old filters."""
    at, rng = str(tmp_path_factory.mktemp("small")), np.random.default_rng(1)
    day = dt.datetime(2024, 1, 1)
    customers = [(c, c % 2) for c in range(990, 1010)]
    orders = [(k, int(rng.integers(990, 1012)), day + dt.timedelta(days=int(rng.integers(0, 40)))) for k in [*range(2990, 3060), *range(10_000, 10_070)]]
    lines = [(o[0], int(s)) for o in orders for s in rng.integers(0, 40, int(rng.integers(1, 12)))]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    return at, dict(customers), orders, lines


def by_site(customers, orders):
    sites = defaultdict(list)
    for k, c, t in orders:
        # Customers 1010 and 1011 are not in the table of customers.
        sites[f"{customers[c]}_{c // 1000}" if c in customers else f"{c // 1000}"].append((t, k, c))
    return {s: sorted(rows) for s, rows in sites.items()}


def test_device_matching_takes_every_order(spark, small):
    at, customers, orders, _ = small
    want = {}
    for site, rows in by_site(customers, orders).items():
        known, n = [], 0
        for _, k, c in rows:
            first, last = (np.array([c % 7 * (i + 1) + k % m / 100 for i in range(6)]).round(3) for m in (3, 2))
            hit = next((x for x in known if np.abs(first - x[1]).sum() <= 0.5 or (np.isclose(first, x[1]) & (first != 0)).sum() > 1), None)
            if hit:
                known.remove(hit)
            else:
                hit, n = (n, None), n + 1
            known.insert(0, (hit[0], last))
            want[k] = (site, hit[0])
    assert {r.trail: (r.site, r.device) for r in Q["device_matching"](spark, at).collect()} == want
    assert len(want) == len(orders)


def test_chain_stitching_takes_every_order(spark, small):
    at, customers, orders, _ = small
    want, hour = {}, dt.timedelta(hours=1)
    for site, rows in by_site(customers, orders).items():
        chains = []
        for t, k, _ in rows:
            fit = [i for i, end in enumerate(chains) if hour * 0 < t - end <= 24 * hour]
            i = max(fit, key=lambda i: (chains[i], -i)) if fit else len(chains)
            chains[i : i + 1] = [t + hour]
            want[k] = (site, i)
    assert {r.device: (r.site, r.chain) for r in Q["chain_stitching"](spark, at).collect()} == want
    assert len(want) == len(orders)


def test_greedy_holdout_takes_every_line(spark, small):
    from pyspark.sql import functions as F

    from trailmark.functions import exprs as X

    at, _, orders, lines = small
    luck = dict(map(tuple, spark.createDataFrame([(o[0],) for o in orders], "k long").select("k", X.hash_unit(F.col("k"), "h")).collect()))
    floors = defaultdict(lambda: defaultdict(set))
    for k, s in lines:
        floors[k // 10_000 * 10 + k % 10][k].add(s)
    want = set()
    for floor, trails in floors.items():
        seen, taken = Counter(a for anchors in trails.values() for a in anchors), 0
        for k, anchors in sorted(trails.items(), key=lambda x: (-len(x[1]), x[0])):
            if taken and len(anchors) < 6:
                break
            alone = sum(seen[a] == 1 for a in anchors)
            if alone <= 0.4 * len(anchors) and alone <= 15 or luck[k] < 0.15:
                want.add((floor, k, len(anchors), alone))
                seen.subtract(anchors)
                taken += 1
    assert {tuple(r) for r in Q["greedy_holdout"](spark, at).select("floor", "trail", "anchors", "alone").collect()} == want
    assert any(k >= 3000 for _, k, _, _ in want)


def test_unpivot_keeps_every_line(spark, tmp_path):
    lines = [(k, 1, 7, 8, dt.datetime(2024, 1, 1), k / 2, 0.1, 0.2, k * 3.0) for k in (1, 1999, 2000, 2001, 70_000)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, measures in (("unpivot_measures", ("quantity", "discount", "tax")), ("unpivot_all_measures", ("quantity", "discount", "tax", "price"))):
        got = Counter((r.l_orderkey, r.measure, r.value) for r in Q[name](spark, str(tmp_path)).collect())
        assert got == Counter((r[0], m, v) for r in lines for m, v in zip(measures, r[5:], strict=False))


def test_nearest_other_trail_takes_every_emitter(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(u), int(k), float(v)) for u, k, v in zip(rng.integers(0, 25, 160), rng.integers(0, 12, 160), rng.integers(0, 12, 160) / 4, strict=True)]
    rows += [(50, 99, 1.0), (51, 99, 1.5), (52, 98, 7.0), (1, None, 3.0), (2, 5, None)]
    full = [(u, i, dt.datetime(2024, 1, 1), v, "view", "{}" if k is None else f'{{"k": {k}}}') for i, (u, k, v) in enumerate(rows)]
    spark.createDataFrame(full, "user_id long, event_id long, ts timestamp, value double, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    top = {}
    for u, k, v in rows:
        if k is not None and v is not None:
            top[u, k] = max(v, top.get((u, k), v))
    want = {}
    for (u, k), v in top.items():
        for (o, j), x in top.items():
            if j == k and o != u:
                want[u] = min(want.get(u, (9e9, 0)), (abs(v - x), o))
    assert {r.user_id: (r.gap, r.other) for r in Q["nearest_other_trail_all"](spark, str(tmp_path)).collect()} == want
    assert want[50] == (0.5, 51) and 52 not in want
