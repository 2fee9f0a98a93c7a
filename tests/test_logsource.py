"""The sensor log source against the text scan, and what its filters leave unread."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from trailmark.plans import intake
from trailmark.sources import logs, logsource

T = 1560915938000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Six training files on two sites, one test file, one that is no log."""
    root = tmp_path_factory.mktemp("logs")
    for k in range(6):
        d = root / "train" / f"site{k % 2}" / f"F{k % 3}"
        d.mkdir(parents=True, exist_ok=True)
        t = T + k * 100_000
        lines = [f"#\tstartTime:{t}", f"#\tSiteID:{k}"]
        lines += [f"{t + i}\tTYPE_WIFI\ts{i}\tb{i}\t-{40 + i}" for i in range(5)]
        lines += [f"{t + 9}\tTYPE_WIFI\ts\tb\t-44{t + 10}\tTYPE_WAYPOINT\t1.5\t{k}.0", "", "broken line", f"#\tendTime:{t + 50}"]
        (d / f"t{k}.txt").write_text("\n".join(lines) + "\n")
    (root / "test").mkdir()
    (root / "test" / "t9.txt").write_text(f"{T + 700_000}\tTYPE_WAYPOINT\t3\t4")
    (root / "test" / "notes.md").write_text("no log")
    return str(root)


def test_same_as_text_scan(spark, folder):
    got = {(r.trail, r.ts, r.tag, tuple(r["values"] if r.tag else ()), r.corrupt) for r in logsource.read_logs(spark, folder, 200).collect()}
    text = logs.repair(logs.read_lines(spark, folder).where("file like '%.txt'"))
    want = {(r.file.rsplit("/", 1)[-1][:-4], r.ts, r.tag, tuple(r["values"] if r.tag else ()), r.corrupt) for r in text.collect()}
    assert got == want and len(got) == 6 * 8 + 1


def test_places_and_filters(spark, folder):
    df = logsource.read_logs(spark, folder)
    assert {(r.mode, r.site, r.floor, r.trail) for r in df.select("mode", "site", "floor", "trail").distinct().collect()} == {("train", f"site{k % 2}", f"F{k % 3}", f"t{k}") for k in range(6)} | {("test", None, None, "t9")}
    got = df.where((F.col("site") == "site1") & F.col("tag").isin("TYPE_WAYPOINT", "TYPE_X") & (F.col("ts") > T + 150_000) & (F.col("ts") <= T + 300_010))
    assert {(r.trail, r.ts) for r in got.collect()} == {("t3", T + 300_010)}
    # A filter that cannot be pushed is Spark's to keep.
    assert df.where("size(values) = 2 and tag = 'TYPE_WAYPOINT'").count() == 7
    assert df.where("corrupt is not null").count() == 6


def test_files_left_unread(folder):
    def reader(*filters):
        r = logsource.SensorLogReader(folder, 1)
        rest = list(r.pushFilters(list(filters)))
        return r, rest

    every, _ = reader()
    assert sum(len(p.paths) for p in every.partitions()) == 7
    site, rest = reader(EqualTo(("site",), "site0"), In(("tag",), ("TYPE_WIFI",)), IsNotNull(("site",)))
    assert [type(f) for f in rest] == [IsNotNull] and sum(len(p.paths) for p in site.partitions()) == 3
    timed, rest = reader(GreaterThan(("ts",), T + 50), LessThanOrEqual(("ts",), T + 200_001))
    assert not rest
    opened = []
    real = logsource.records

    def spy(lines):
        opened.append(1)
        return real(lines)

    logsource.records = spy
    try:
        rows = [r for p in timed.partitions() for b in timed.read(p) for r in b.to_pylist()]
    finally:
        logsource.records = real
    # Headers rule out all but two training files; the test file has none and is read.
    assert len(opened) == 3 and {r["trail"] for r in rows} == {"t1", "t2"} and all(T + 50 < r["ts"] <= T + 200_001 for r in rows)


def test_empty_folder(spark, tmp_path):
    assert logsource.read_logs(spark, str(tmp_path)).count() == 0


def test_many_trails_in_a_file(spark, tmp_path):
    """Records go to the trail that the last line named, and filters on trails look into such files."""
    (tmp_path / "site=1").mkdir()
    text = f"{T}\tTYPE_A\t0\n#\ttrail:7\n#\tstartTime:{T + 900}\n{T + 1}\tTYPE_A\t1\n{T + 2}\tTYPE_B\t2\n#\ttrail:x:8\n#\tendTime:{T - 900}\n#\ttrail:9\r\n{T + 3}\tTYPE_A\t3\n#\ttrail:7\n{T + 4}\tTYPE_A\t4"
    (tmp_path / "site=1" / "part.txt").write_text(text)
    df = logsource.read_logs(spark, str(tmp_path))
    at = lambda df: {(r.trail, r.ts - T) for r in df.collect()}
    assert at(df) == {(None, 0), ("7", 1), ("7", 2), ("9", 3), ("7", 4)} and {r.site for r in df.collect()} == {"1"}
    assert at(df.where("trail = '7' and tag = 'TYPE_A'")) == {("7", 1), ("7", 4)}
    # Ends of one trail say nothing of the others.
    assert at(df.where(F.col("ts") >= T + 3)) == {("9", 3), ("7", 4)} and not df.where("trail = '6' or site = '2'").count()


def test_log_files_do_not_grow_with_trails(spark, tmp_path, monkeypatch):
    day = dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
    rows = [(i, day + dt.timedelta(seconds=i % 40), i % 300, ("view", "purchase", "click")[i % 7 % 3], 1.0, f'{{"k": {i % 9}}}') for i in range(3000)]
    # A trail of more than one block, with equal times.
    rows += [(3000 + i, day + dt.timedelta(seconds=i // 50), 301, "view", 1.0, '{"k": 2}') for i in range(2500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(intake, "scratch", lambda spark: f"{tmp_path}/logs")
    got = {(r.site, r.trail, r.tag): (r.n, r.total) for r in intake.log_source(spark, str(tmp_path)).collect()}
    want = {}
    for _, _, u, kind, _, props in rows:
        if u % 5 in (1, 3) and kind != "click":
            n, total = want.get(k := (str(u % 5), str(u), f"TYPE_{kind.upper()}"), (0, 0))
            want[k] = (n + 1, total + int(props[6:-1]))
    assert got == want and want["1", "301", "TYPE_VIEW"] == (2500, 5000)
    assert len(list((tmp_path / "logs").rglob("*.txt"))) < 50
