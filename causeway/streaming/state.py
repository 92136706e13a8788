"""Streaming forms: running averages, latest feed snapshots, sticky regimes and growing hash chains.

All take a streaming frame whose rows arrive in ``order`` within a micro-batch and give a row
per key and micro-batch; state per key has a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causeway.operators.events import GENESIS

SEVERITY = ("none", "High Volatility", "Crisis")


def _folded(rows: DataFrame, key: str, order: str, start: tuple, step: Callable[[tuple, Any], tuple], out: str, state: str) -> DataFrame:
    """Per key, the state after each micro-batch: ``step`` of the state and each row in order."""
    kind = rows.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in out.split(", ")]

    def fold(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        for row in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            now = step(now, row)
        held.update(now)
        yield pd.DataFrame([[k[0], *now]], columns=[key, *names])

    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {out}", state, "update", GroupStateTimeout.NoTimeout)


def ewma(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.2) -> DataFrame:
    """The exponential average of each key from 0; values that are no finite number don't count."""

    def step(now: tuple, row: Any) -> tuple:
        v = getattr(row, value)
        return now if v is None or v != v or abs(v) == float("inf") else ((1 - alpha) * now[0] + alpha * v,)

    return _folded(rows, key, order, (0.0,), step, "ewma double", "ewma double")


def sticky_regime(rows: DataFrame, key: str, order: str, impact: str) -> DataFrame:
    """The worst regime that each key's largest impact, their sum and their number have ever meant."""

    def step(now: tuple, row: Any) -> tuple:
        a = abs(getattr(row, impact))
        top, total, hits = max(now[0], a), now[1] + a, now[2] + (a >= 0.1)
        level = 2 if top >= 0.6 or total >= 1.5 or hits >= 6 else 1 if top >= 0.3 or hits >= 4 else 0
        return top, total, hits, max(now[3], level)

    fields = "top double, total double, hits long, severity int"
    return _folded(rows, key, order, (0.0, 0.0, 0, 0), step, fields, fields)


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key by arrival."""
    fields = f"{value} {rows.schema[value].dataType.simpleString()}"
    return _folded(rows, key, order, (None,), lambda now, row: (getattr(row, value),), fields, fields)


def chain(rows: DataFrame, key: str, order: str, payload: str, created: str) -> DataFrame:
    """The hash chain of each key, which goes on from its last hash with every micro-batch."""

    def step(now: tuple, row: Any) -> tuple:
        return now[0] + 1, hashlib.sha256(f"{getattr(row, payload)}|{getattr(row, created)}|{now[1]}".encode()).hexdigest()

    fields = "n_events long, head_hash string"
    return _folded(rows, key, order, (0, GENESIS), step, fields, fields)


def expiring(rows: DataFrame, key: str, time: str, value: str, lifetime: str, late: str = "0 seconds") -> DataFrame:
    """Of each key, its newest value by event time, and its end: (key, value, at, expired).

    A row comes with every micro-batch that brings a newer value, and one with ``expired`` once the watermark is ``lifetime`` past
    the newest value's time, when the key's state is dropped.  Rows behind the watermark, which trails the newest
    time seen by ``late``, don't count.  State is one value for each key that is alive.
    """
    kind = rows.schema[key].dataType.simpleString()
    held_kind = f"{value} {rows.schema[value].dataType.simpleString()}, at timestamp"
    life = int(pd.Timedelta(lifetime).total_seconds() * 1000)

    def fold(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            v, at = held.get
            held.remove()
            yield pd.DataFrame([[k[0], v, at, True]], columns=[key, value, "at", "expired"])
            return
        now = held.get if held.exists else None
        # A row may be older than the watermark of the state it meets, but for what the engine has left out already.
        new = [(r[0], r[1]) for b in batches for r in b[[value, time]].itertuples(index=False) if not pd.isna(r[1])]
        new = [x for x in new if x[1].timestamp() * 1000 + life > held.getCurrentWatermarkMs()]
        if not new:
            return
        v, at = max(new, key=lambda x: x[1])
        if now is None or at > pd.Timestamp(now[1]):
            held.update((v, at.to_pydatetime()))
            held.setTimeoutTimestamp(int(at.timestamp() * 1000) + life)
            yield pd.DataFrame([[k[0], v, at, False]], columns=[key, value, "at", "expired"])

    timed = rows.withWatermark(time, late)
    return timed.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {held_kind}, expired boolean", held_kind, "update", GroupStateTimeout.EventTimeTimeout)
