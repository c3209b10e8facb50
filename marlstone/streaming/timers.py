"""Sessions as state of our own, closed by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def merged_spans(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Spans (first, last, n) in order, those less than ``gap`` apart as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap:
            before = out.pop()
            out.append((before[0], max(before[1], last), before[2] + n))
        else:
            out.append((first, last, n))
    return out


def spans_of(times: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """Spans (first, last, n) of ``times`` in any order, cut where two are at least ``gap`` apart."""
    if not len(times):
        return []
    times = np.sort(times)
    starts = np.flatnonzero(np.diff(times, prepend=times[0] - gap) >= gap)
    ends = np.append(starts[1:], len(times))
    return list(zip(times[starts].tolist(), times[ends - 1].tolist(), (ends - starts).tolist(), strict=True))


class _Sessions(StatefulProcessor):
    """Open sessions of a key as one value of three arrays, and one timer at the first end plus the gap.

    When it expires, all sessions that the watermark has passed are reported and forgotten at once, and
    the timer is set for the first of the others; so the state is read once a batch, not once a session.
    """

    def __init__(self, key: str, gap_ms: int):
        self.key, self.gap = key, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first array<long>, last array<long>, n array<long>")

    def _spans(self) -> list[tuple[int, int, int]]:
        held = self.open.get()
        return list(zip(*held, strict=True)) if held else []

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        self.open.update(tuple(map(list, zip(*spans, strict=True))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self._spans()
        for frame in rows:
            # a frame is merged at once, so that what is held are sessions and not events
            times = frame["at_us"].dropna().to_numpy(dtype="int64")
            spans = merged_spans(spans + spans_of(times, self.gap * 1000), self.gap * 1000)
        first = min(map(self._due, spans), default=None)
        for old in list(self.handle.listTimers()):
            if old != first:
                self.handle.deleteTimer(old)
        if spans:
            self.handle.registerTimer(first)
            self._keep(spans)
        yield from ()

    def _due(self, span: tuple[int, int, int]) -> int:
        return -(-span[1] // 1000) + self.gap

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer expires when the watermark is beyond it
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        spans = self._spans()
        done = [s for s in spans if self._due(s) <= due]
        left = [s for s in spans if self._due(s) > due]
        if left:
            self.handle.registerTimer(min(map(self._due, left)))
            self._keep(left)
        else:
            self.open.clear()
        if done:
            yield pd.DataFrame({self.key: [key[0]] * len(done), "first_us": [s[0] for s in done], "last_us": [s[1] for s in done], "n": [s[2] for s in done]})

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, key: str, event_time: str, gap_ms: int) -> DataFrame:
    """Sessions of every ``key`` (``key``, first_us, last_us, n), each once, when the watermark has passed its end by ``gap_ms``.

    Rows less than ``gap_ms`` apart are of one session. State holds open sessions only; it needs
    :func:`marlstone.streaming.runs.rocksdb_state`. Rows behind the watermark are dropped before, null times count nowhere.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, event_time, F.unix_micros(event_time).alias("at_us"))
    return rows.groupBy(key).transformWithStateInPandas(
        _Sessions(key, gap_ms), f"{key} {kind}, first_us long, last_us long, n long", "Append", "EventTime"
    )
