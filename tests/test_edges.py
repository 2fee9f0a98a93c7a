"""Edge records against plain loops."""

import math
from collections import defaultdict

import numpy as np
import pytest

from trailmark.operators import edges as E


def world(seed=7, n=70):
    rng = np.random.default_rng(seed)
    trails, readings = [], []
    clock = defaultdict(int)
    for k in range(n):
        site = f"s{k % 2}"
        t = 1_560_000_000_000 + int(rng.integers(0, 4 * 86_400_000))
        if k % 9 == 0:
            t = 1_560_000_000_000 + 5_000_000 * (k // 9)
        end = t + int(rng.integers(10_000, 3_000_000))
        mode = ["train", "train", "valid", "test"][int(rng.integers(4))]
        on_path = mode == "test" and k % 3 == 0
        order = None
        if on_path:
            order = clock[site]
            clock[site] += 1
        dev = int(rng.integers(2))
        num = lambda: float(rng.uniform(0, 50))
        trails.append((site, f"t{k:03d}", mode, t, end, int(rng.integers(3)), 3 + k % 5, num(), num(), num(), num(), dev, dev + 10, dev + 20, order, dev if on_path and k % 2 else (-1 if on_path else None), ["start", "end", None][int(rng.integers(3))] if mode == "test" else None))
        for scan in range(int(rng.integers(0, 4))):
            for e in range(int(rng.integers(2, 6))):
                readings.append((site, f"t{k:03d}", t + 1000 * scan, t + 1000 * scan - int(rng.choice([0, 500, 20_000])), f"e{e}", -60 - int(rng.integers(0, 6))))
    return trails, readings


TRAILS = "site string, fn string, mode string, start_time long, end_time long, floor int, num_waypoints int, first_x double, first_y double, last_x double, last_y double, device_id int, device_id_drift int, device_id_merged int, path_order int, path_device int, leak string"


def brute(trails, readings, valid):
    names = [c.split()[0] for c in TRAILS.split(", ")]
    rows = [dict(zip(names, t, strict=True)) for t in trails]

    def edge(r, last):
        own = [x for x in readings if x[:2] == (r["site"], r["fn"])]
        if not own:
            return None
        scan = (max if last else min)(x[2] for x in own)
        own = [x for x in own if x[2] == scan]
        newest = max(x[3] for x in own)
        return {x[4]: x[5] for x in own if newest - x[3] <= 10_000}

    def alike(a, b):
        if a is None or b is None:
            return -1, -1
        both = set(a) & set(b)
        return 2 * len(both) / (len(a) + len(b)), np.mean([abs(a[e] - b[e]) for e in both]) if both else 20

    out = {}
    for r in rows:
        if r["mode"] != ("valid" if valid else "test"):
            continue
        got = {"num_waypoints": r["num_waypoints"], "first_x": r["first_x"], "last_y": r["last_y"], "actual_device_id_drift": r["device_id_drift"], "actual_floor": r["floor"]}
        mates = [o for o in rows if o["site"] == r["site"]]
        for side, before in (("preceding", True), ("succeeding", False)):
            if (r["path_device"] if r["path_device"] is not None else -1) >= 0:
                want = r["path_order"] + (-1 if before else 1)
                found = [o for o in mates if o["path_order"] == want and o["path_device"] == r["path_device"]]
            elif before:
                found = sorted((o for o in mates if o["end_time"] < r["start_time"]), key=lambda o: (-o["end_time"], o["fn"]))[:5]
            else:
                found = sorted((o for o in mates if o["start_time"] > r["end_time"]), key=lambda o: (o["start_time"], o["fn"]))[:5]
            judged, floors, pick = [], set(), 0
            for i, o in enumerate(found):
                delay = r["start_time"] - o["end_time"] if before else o["start_time"] - r["end_time"]
                fraction, mean = alike(edge(o, True), edge(r, False)) if before else alike(edge(r, True), edge(o, False))
                dis = 10 * (1 - fraction) + mean + 15 * (fraction <= 0.1) + max(0, min(4, math.log2(max(delay, 1) / 10000)))
                use = (o["mode"] != "test" or o["leak"] == ("end" if before else "start")) and not (valid and o["mode"] == "valid")
                judged.append((o, delay, fraction, mean, dis, use, use and dis < 12 and o["device_id"] == r["device_id"]))
            for i, j in enumerate(judged):
                if j[-1] and j[0]["floor"] not in floors:
                    pick = i
                    break
                floors.add(j[0]["floor"])
            if not judged:
                got |= {f"can_use_{side}": False, f"delay_{side}": -1, f"{side}_mode": "None", f"{side}_fn": None, f"{side}_shared_fraction": -1, f"reliable_{side}": False, f"{side}_match_offset_fn": None, f"{side}_x": None}
                continue
            o, delay, fraction, mean, dis, use, ok = judged[pick]
            x = o["last_x" if before else "first_x"]
            got |= {f"can_use_{side}": use, f"delay_{side}": delay, f"{side}_shared_fraction": fraction, f"{side}_mean_dist": mean, f"{side}_dissimilarity": dis, f"{side}_mode": o["mode"], f"{side}_fn": o["fn"], f"{side}_device_id_merged": o["device_id_merged"], f"{side}_floor": o["floor"], f"{side}_match_offset_fn": pick, f"{side}_x": x if use else None, f"reliable_{side}": ok, f"reliable_{side}_floor": o["floor"] if ok else None, f"reliable_{side}_device_id": o["device_id"] if ok else None}
        out[r["site"], r["fn"]] = got
    return out


@pytest.mark.parametrize("valid", [False, True])
def test_edge_records(spark, valid):
    trails, readings = world()
    got = E.edge_records(spark.createDataFrame(trails, TRAILS), spark.createDataFrame(readings, "site string, fn string, scan long, heard long, emitter string, rssi int"), valid)
    assert got.columns == list(E.RESULT) and len(E.RESULT) == 45
    want = brute(trails, readings, valid)
    have = {(r.site, r.fn): r for r in got.collect()}
    assert set(have) == set(want)
    later = reliable = 0
    for key, w in want.items():
        for c, v in w.items():
            assert have[key][c] == (pytest.approx(v) if isinstance(v, float) else v), (key, c)
        later += (w["preceding_match_offset_fn"] or 0) > 0
        reliable += w["reliable_succeeding"]
    assert reliable and (later or valid)
