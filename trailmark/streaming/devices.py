"""Device matching on a stream: trajectories of a site told apart by six offsets, in the order of their times.

Each site is keyed state. Trajectories wait, by time, until the watermark has passed
them; a timer then matches those that are due in order, as ``operators.stateful``
does for a whole table, and only what is known of devices stays: six offsets and the
time of last use each. Devices unused for longer than ``forget_ms`` are forgotten, so
state is bounded by the lateness allowed and the devices of that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.stateful import known_device

WAITING = "ms long, trail string, offsets array<double>, last array<double>"
KNOWN = "device int, used long, offsets array<double>"


class Matcher(StatefulProcessor):
    def __init__(self, site: str, limit: float, scale: float, forget_ms: int | None):
        self.site, self.limit, self.scale, self.forget_ms = site, limit, scale, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.known = handle.getListState("known", KNOWN)
        self.next = handle.getValueState("next", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.ms), str(r.trail), _list(r.offsets), _list(r.last)) for pdf in rows for r in pdf.itertuples()]
        self.waiting.appendList(new)
        for ms in {r[0] for r in new}:
            self.handle.registerTimer(ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r[0] < due), key=lambda r: (r[0], r[1]))
        if not ready:
            return iter(())
        rest = [r for r in rows if r[0] >= due]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        known = [[d, used, _list(o)] for d, used, o in self.known.get()]
        n = self.next.get()[0] if self.next.exists() else 0
        out = []
        for ms, trail, offsets, last in ready:
            device, n = known_device(known, n, ms, offsets, last, self.limit, self.scale, self.forget_ms)
            out.append((key[0], trail, ms, device))
        if known:
            self.known.put([tuple(k) for k in known])
        self.next.update((n,))
        return iter([pd.DataFrame(out, columns=[self.site, "trail", "ms", "device"])])

    def close(self) -> None:
        pass


def _list(x) -> list[float] | None:
    return None if x is None else [float("nan") if v is None else float(v) for v in x]


def match_devices(stream: DataFrame, site: str, ts: str, late: str, limit: float = 0.5, scale: float = 1.0, forget_ms: int | None = None) -> DataFrame:
    """``site, trail, ms, device`` of a stream of trajectories (site, ``ts`` timestamp, trail, first, last).

    ``first`` and ``last`` are the six offsets that a trajectory begins and ends with.
    A row comes out once the watermark, ``late`` behind the latest time, has passed
    it; a row later than that is dropped. The state store must be RocksDB.
    """
    kinds = dict(stream.dtypes)
    rows = stream.withWatermark(ts, late).select(site, ts, F.unix_millis(ts).alias("ms"), F.col("trail").cast("string").alias("trail"), F.col("first").alias("offsets"), "last")
    out = f"{site} {kinds[site]}, trail string, ms long, device int"
    return rows.groupBy(site).transformWithStateInPandas(Matcher(site, limit, scale, forget_ms), out, "append", "EventTime")
