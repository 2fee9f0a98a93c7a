"""Sensor logs as a data source: ``spark.read.format("sensorlog").load(path)``.

Files below a path are dealt to partitions by their bytes; each is read line by line,
glued records are cut apart, and Arrow batches go to Spark. Filters on the file's
place (mode, site, floor, trail) leave files unread; filters on a record's time leave
those unread whose header and footer say that they ended before or began after; filters on kind
and time drop records before they become rows. A file may hold many trails: a line
``#<tab>trail:name`` says whose records follow. Any store that ``pyarrow.fs`` opens
will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "mode string, site string, floor string, trail string, ts long, tag string, values array<string>, corrupt string"
#: Bytes of a partition, and rows of a batch.
PARTITION = 32 << 20
ROWS = 20_000
#: Bytes of a file's head and tail in which its start and end time are looked for.
EDGE = 4096
_STAMP = re.compile(r"(?=\d{13}\tTYPE_)")
_TRAIN = re.compile(r"/(train)/([^/]+)/([^/]+)/([^/]+)\.txt$")
_TEST = re.compile(r"/(test)/([^/]+)\.txt$")
_FOLDER = re.compile(r"/(mode|site|floor|trail)=([^/]+)")
_TRAIL = "#\ttrail:"
_ENDS = re.compile(r"(startTime|endTime):(\d+)")
_ARROW = pa.schema([("mode", pa.string()), ("site", pa.string()), ("floor", pa.string()), ("trail", pa.string()), ("ts", pa.int64()), ("tag", pa.string()), ("values", pa.list_(pa.string())), ("corrupt", pa.string())])


def place_of(path: str) -> dict[str, str | None]:
    """Mode, site, floor and trail of a file: train/site/floor/trail.txt or test/trail.txt, or folders named like site=1; elsewhere the trail is the file's name."""
    if m := _TRAIN.search(path):
        return dict(zip(("mode", "site", "floor", "trail"), m.groups(), strict=True))
    if m := _TEST.search(path):
        return {"mode": m[1], "site": None, "floor": None, "trail": m[2]}
    if found := dict(_FOLDER.findall(path)):
        return {c: found.get(c) for c in ("mode", "site", "floor", "trail")}
    return {"mode": None, "site": None, "floor": None, "trail": path.rsplit("/", 1)[-1].removesuffix(".txt")}


@dataclass
class Wanted:
    """What pushed filters ask for: values by column, and the least and largest time."""

    values: dict[str, set] = field(default_factory=dict)
    low: int = -(2**63)
    high: int = 2**63 - 1

    def take(self, f: Filter) -> bool:
        """Note a filter; whether it is one that can be kept to exactly."""
        if not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or len(f.attribute) != 1:
            return False
        column, value = f.attribute[0], f.value
        if isinstance(f, EqualTo | In) and column in ("mode", "site", "floor", "trail", "tag"):
            asked = set(value) if isinstance(f, In) else {value}
            self.values[column] = self.values.get(column, asked) & asked
            return True
        if column != "ts" or isinstance(f, In):
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high = min(self.high, value - isinstance(f, LessThan))
        return True

    @property
    def timed(self) -> bool:
        return self.low > -(2**63) or self.high < 2**63 - 1

    def file(self, path: str) -> bool:
        at = place_of(path)
        # Of a file in folders that name no trail only its lines say whose it is.
        return all(at[c] in v or (c == "trail" and at[c] is None) for c, v in self.values.items() if c != "tag")

    def record(self, ts: int | None, tag: str | None) -> bool:
        return ("tag" not in self.values or tag in self.values["tag"]) and (not self.timed or (ts is not None and self.low <= ts <= self.high))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...] = ()


def by_trail(lines: Iterator[str], trail: str | None) -> Iterator[tuple[str | None, Iterator[str]]]:
    """Lines of each trail in turn; those before the first line that names one are of ``trail``."""

    def named() -> Iterator[tuple[str | None, str]]:
        now = trail
        for line in lines:
            if line.startswith(_TRAIL):
                now = line.removeprefix(_TRAIL).rstrip("\r\n")
            yield now, line

    for now, part in groupby(named(), key=lambda x: x[0]):
        yield now, (line for _, line in part)


def records(lines: Iterator[str]) -> Iterator[tuple[int | None, str | None, list[str], str | None]]:
    """(ts, tag, values, corrupt) of each record; blank and ``#`` lines are none, a record without a tag is corrupt."""
    for line in lines:
        line = line.rstrip("\r\n")
        if not line.strip() or line.startswith("#"):
            continue
        for rec in _STAMP.split(line):
            if not rec:
                continue
            cells = rec.split("\t")
            if "TYPE_" not in rec or len(cells) < 2:
                yield None, None, cells[2:], rec
            else:
                yield int(cells[0]) if cells[0].isdigit() else None, cells[1], cells[2:], None


class SensorLogReader(DataSourceReader):
    def __init__(self, path: str, size: int = PARTITION):
        self.path, self.size, self.wanted = path, size, Wanted()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> Sequence[InputPartition]:
        """Files that their place does not rule out, dealt in order until a partition is full."""
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".txt") and self.wanted.file(f.path))
        out, now, total = [], [], 0
        for path, size in files:
            if now and total + size > self.size:
                out.append(Files(tuple(now)))
                now, total = [], 0
            now.append(path)
            total += size
        return [*out, Files(tuple(now))]

    def _overlaps(self, edges: str) -> bool:
        """Whether a file's header and footer leave room for the times asked for; a file that does not say may hold any."""
        if _TRAIL in edges:
            return True  # Ends of one trail among others.
        ends = dict(m.groups() for m in _ENDS.finditer(edges))
        return int(ends.get("startTime", self.wanted.low)) <= self.wanted.high and int(ends.get("endTime", self.wanted.high)) >= self.wanted.low

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        rows: list[tuple] = []
        for path in partition.paths:
            *at, own = place_of(path).values()
            with store.open_input_file(path) as raw:
                if self.wanted.timed and not self._overlaps(_edges(raw)):
                    continue
                lines = (x.decode("utf-8", "replace") for x in _lines(raw))
                for trail, part in by_trail(lines, own):
                    if trail not in self.wanted.values.get("trail", {trail}):
                        continue
                    for ts, tag, values, corrupt in records(part):
                        if self.wanted.record(ts, tag):
                            rows.append((*at, trail, ts, tag, values, corrupt))
                            if len(rows) >= ROWS:
                                yield _batch(rows)
                                rows = []
        if rows:
            yield _batch(rows)


def _edges(raw: pa.NativeFile) -> str:
    """The comments among the first and last bytes of a file, which is left at its beginning."""
    head = raw.read(EDGE)
    raw.seek(max(0, raw.size() - EDGE))
    tail = raw.read(EDGE)
    raw.seek(0)
    return "\n".join(x for x in (head + b"\n" + tail).decode("utf-8", "replace").split("\n") if x.startswith("#"))


def _lines(raw, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream, read in pieces."""
    rest = b""
    while piece := raw.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class SensorLogs(DataSource):
    """Options: path, and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "sensorlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SensorLogReader:
        return SensorLogReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION)))


def read_logs(spark: SparkSession, path: str, partition_bytes: int = PARTITION) -> DataFrame:
    """Records of all log files below ``path``, with filters pushed into the files."""
    spark.dataSource.register(SensorLogs)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sensorlog").option("partition_bytes", str(partition_bytes)).load(path)
