"""Ordered event folds on streams: entitlements that late events can't overturn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noteloom.operators.deltas import LIVE_STATUSES

OUTPUT = "vault string, created long, status string, quota_bytes long, active boolean"
#: Rows that a task holds before it hands on the newest of each key.
_HELD = 500_000
_STATE = "created long, status string, quota_bytes long, active boolean"


def newest(rows: DataFrame, key: str, order: list[tuple[str, str]], latest: bool) -> DataFrame:
    """Of some hundred thousand rows of a task at a time the first of each key in an order; of equal ones the ``latest`` to come, or the earliest.

    A fold that only keeps such a row gets the same from these rows as from all, and neither the shuffle nor its state meets the others.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= _HELD:
                yield from first(held)
                held = []
        if held:
            yield from first(held)

    def first(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = pc.fill_null(table.column(key).combine_chunks().dictionary_encode().indices, -1) if len(table) else pa.array([], pa.int32())
        keyed = pa.table([codes, *(table.column(c) for c, _ in order), pa.array(np.arange(len(table)))], names=["code", *(c for c, _ in order), "__at"])
        by = pc.sort_indices(keyed, sort_keys=[("code", "ascending"), *order, ("__at", "descending" if latest else "ascending")])
        code = codes.take(by).to_numpy()
        begins = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.empty(0, bool)
        return table.take(by.filter(pa.array(begins, pa.bool_()))).select(names).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Apply events that are newer than the last one applied; a removal leaves its time behind."""
    now = state.get if state.exists else None
    changed = False
    for pdf in frames:
        for row in pdf.sort_values(["created", "event_id"], kind="stable").itertuples(index=False):
            if now is not None and row.created <= now[0]:
                continue
            live = not row.type.endswith("deleted") and row.status in LIVE_STATUSES
            quota = int(row.quota_bytes) if live and pd.notna(row.quota_bytes) else None
            now, changed = (int(row.created), row.status, quota, live), True
    if changed:
        state.update(now)
        yield pd.DataFrame({"vault": [key[0]], "created": [now[0]], "status": [now[1]], "quota_bytes": pd.array([now[2]], dtype="Int64"), "active": [now[3]]})


def entitlements(events: DataFrame) -> DataFrame:
    """The entitlement of each vault whenever it changes, of a stream (vault, event_id, type, status, created, quota_bytes).

    No watermark drops late events: a late one is simply older than what was applied.
    """
    rows = events.selectExpr("vault", "event_id", "coalesce(type, '') type", "status", "cast(created as long) created", "cast(quota_bytes as long) quota_bytes")
    rows = newest(rows.where("created IS NOT NULL"), "vault", [("created", "descending"), ("event_id", "ascending")], False)
    return rows.groupBy("vault").applyInPandasWithState(_fold, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)
