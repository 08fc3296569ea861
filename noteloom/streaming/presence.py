"""Who is present: the last update of each device, kept with timers in RocksDB state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from noteloom.streaming.folds import newest

TTL_MS = 45_000
#: How long the time of a departure is remembered, so that older updates that come late don't bring a device back.
FORGET_MS = 24 * 3_600_000
OUTPUT = "device string, ts long, note_id string, editing boolean, present boolean"
_STATE = "ts long, note_id string, editing boolean, present boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Presence(StatefulProcessor):
    """Last writer by time, of equal times the later one to come; an older update is stale, an older ``gone`` too."""

    def __init__(self, ttl_ms: int | None, forget_ms: int):
        self.ttl_ms, self.forget_ms = ttl_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # timers and the state's own end need processing time, which a stream without a time to live doesn't use
        self.last = handle.getValueState("last", _STATE, None if self.ttl_ms is None else self.forget_ms)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for row in initialState.itertuples(index=False):
            self._keep((int(row.ts), row.note_id, bool(row.editing), True), timerValues)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, changed = self.last.get(), False
        for pdf in rows:
            for row in pdf.sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
                if now is None or row.ts >= now[0]:
                    now, changed = (int(row.ts), row.note_id, bool(row.editing), not bool(row.gone)), True
        if changed:
            self._keep(now, timerValues)
            yield self._told(key, now)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = self.last.get()
        if now is not None and now[3]:
            silent = (now[0], now[1], now[2], False)
            self.last.update(silent)
            yield self._told(key, silent)

    def _keep(self, now: tuple, timerValues: TimerValues) -> None:
        self.last.update(now)
        if self.ttl_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if now[3]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def _told(self, key: Any, now: tuple) -> pd.DataFrame:
        return pd.DataFrame({"device": [key[0]], "ts": [now[0]], "note_id": [now[1]], "editing": [now[2]], "present": [now[3]]})


def presence(updates: DataFrame, ttl_ms: int | None = None, initial: DataFrame | None = None, forget_ms: int = FORGET_MS) -> DataFrame:
    """Changes of presence of a stream (device, ts in ms, gone, note_id, editing, and seq where updates are numbered).

    A device's departure stays in its state as a marker of its time, so older updates that come late don't bring it
    back. With ``ttl_ms`` a device silent for that long in processing time is reported as gone, by a timer that a continuous trigger
    fires, and markers go after ``forget_ms``. ``initial``: devices (device, ts, note_id, editing) that are present when the stream first starts,
    as ``deltas.presence_state`` gives them of what was before; their time to live begins then.
    """
    spark = updates.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    seq = "cast(seq as long) seq" if "seq" in updates.columns else "0L seq"
    rows = updates.selectExpr("device", "cast(ts as long) ts", seq, "coalesce(gone, false) gone", "note_id", "coalesce(editing, false) editing")
    # rows without a number sort behind those with one, as in the fold
    rows = newest(rows.where("ts IS NOT NULL").selectExpr("device", "ts", "coalesce(seq, 9223372036854775807) seq", "gone", "note_id", "editing"), "device", [("ts", "descending"), ("seq", "descending")], True)
    before = None if initial is None else initial.selectExpr("device", "cast(ts as long) ts", "note_id", "coalesce(editing, false) editing").groupBy("device")
    mode = "none" if ttl_ms is None else "processingTime"
    return rows.groupBy("device").transformWithStateInPandas(_Presence(ttl_ms, forget_ms), OUTPUT, "Update", mode, before)
