import numpy as np
from pyspark.sql import functions as F

from trailmark.operators import stateful as Z
from trailmark.streaming import devices, windows


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path, rows, schema):
    p = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(p)
    return spark.readStream.schema(schema).parquet(p)


def test_sliding_and_sessions_agree_with_batch(spark, tmp_path):
    rows = [("f", x, float(x)) for x in (0, 5, 9, 30, 31, 90)]
    s = source(spark, tmp_path, rows, "fn string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = run(spark, windows.sliding(s, ["fn"], "ts", "v", "10 seconds", "5 seconds", "1 minute"), "slide", "complete")
    assert got.where("start = timestamp_seconds(0)").first().n == 3
    gap = run(spark, windows.sessions(s, ["fn"], "ts", "10 seconds", "1 minute"), "gaps", "complete")
    assert sorted(r.n for r in gap.collect()) == [1, 2, 3]


def test_last_device(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 2, 9.0), ("a", 3, 1.2), ("a", 4, 1.5), ("a", 5, 9.1)]
    s = source(spark, tmp_path, rows, "site string, trail long, v double")
    got = run(spark, windows.last_device(s, "site", "trail", "v", 0.4), "dev")
    assert {r.trail: r.device for r in got.collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_match_devices_as_in_batch(spark, tmp_path):
    """Several files, out of order within the lateness allowed: the same devices as a whole table gives."""
    rng = np.random.default_rng(5)
    signatures = rng.normal(0, 20, (4, 6)).round(3)
    rows = []
    for k in range(160):
        dev = int(rng.integers(4))
        drift = rng.normal(0, 0.02, 6)
        first = [float(v) for v in signatures[dev] + drift]
        last = [float(v) for v in signatures[dev] + drift * 2]
        rows.append((f"s{k % 3}", 1_700_000_000_000 + k * 60_000, f"t{k:03d}", None if k % 23 == 0 else first, last))
    schema = "site string, time long, trail string, first array<double>, last array<double>"
    batch = {}
    for forget in (None, 900_000):
        got = Z.match_devices(spark.createDataFrame(rows, schema), ["site"], 0.5, 1.0, forget)
        batch[forget] = {(r.site, r.trail): r.device for r in got.collect()}
    assert batch[None] != batch[900_000] and -1 in batch[None].values()
    at = tmp_path / "in"
    order = np.argsort(np.arange(160) + rng.uniform(0, 8, 160))
    end = [("s0", rows[-1][1] + 10_000_000, "end", None, None)]
    for i in range(0, 160, 40):
        spark.createDataFrame([rows[j] for j in order[i : i + 40]] + (end if i == 120 else []), schema).coalesce(1).write.mode("append").parquet(str(at))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for forget in (None, 900_000):
            s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at)).withColumn("ts", F.timestamp_millis("time"))
            got = run(spark, devices.match_devices(s, "site", "ts", "20 minutes", forget_ms=forget), f"dev{forget}")
            have = {(r.site, r.trail): r.device for r in got.collect()}
            assert have == batch[forget]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
