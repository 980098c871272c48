"""Streams in event time: events are held until the watermark has passed them, then taken in order, key by key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def in_order(stream: DataFrame, key: str, event: str, value: str, late: str, step: Callable, columns: str) -> DataFrame:
    """What ``step`` makes of each key's events, in the order of ``ts`` and ``event`` whatever order they arrive in.

    ``step(memo, instant, value)`` gets what it left behind for the key (None at first), the event's instant in
    microseconds and its value, and returns the new memo and a tuple of ``columns``, or None for no row; rows have
    ``key`` and ``event`` before these. Memos are kept as JSON.

    An event is taken when the watermark, ``late`` behind the last event of the stream, is past it; one that comes when
    the watermark has passed it is dropped. State holds a key's memo and its events since the watermark, so it
    follows the delay, not the stream. Events without key or instant are dropped.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memo, held = (json.loads(x) for x in state.get) if state.exists else (None, [])
        for rows in frames:
            held += zip(rows["_at"].tolist(), rows["_event"].tolist(), rows["_value"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        held.sort(key=lambda x: (x[0], x[1]))
        due = next((i for i, x in enumerate(held) if x[0] // 1000 >= mark), len(held))
        out = []
        for at, e, v in held[:due]:
            memo, row = step(memo, at, v)
            if row is not None:
                out.append((*k, e, *row))
        held = held[due:]
        state.update((json.dumps(memo), json.dumps(held)))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000, mark + 1))
        yield pd.DataFrame(out, columns=names)

    some = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    types = {f.name: f.dataType.simpleString() for f in some.schema}
    schema = f"{key} {types[key]}, {event} {types[event]}, {columns}"
    names = [x.split()[0] for x in schema.split(", ")]
    timed = some.withWatermark("ts", late).withColumn("_at", F.unix_micros("ts")).select(key, "ts", "_at", F.col(event).alias("_event"), F.col(value).alias("_value"))
    return timed.groupBy(key).applyInPandasWithState(run, schema, "memo string, held string", "append", GroupStateTimeout.EventTimeTimeout)


def changes(stream: DataFrame, key: str, event: str, text: str, late: str) -> DataFrame:
    """``key``, ``event``, ``before``, ``after``: events whose text differs from that of the key's event before it."""

    def step(memo, at, now):
        return [now], (memo[0], now) if memo and memo[0] != now else None

    return in_order(stream, key, event, text, late, step, "before string, after string")


def limited(stream: DataFrame, key: str, event: str, limit: int, seconds: float, late: str) -> DataFrame:
    """``key``, ``event``, ``allowed``: the first ``limit`` events of windows that open with a key's first event after the last window, in event time."""

    def step(memo, at, _):
        opened, n = memo or (None, 0)
        if opened is None or at - opened >= seconds * 1e6:
            opened, n = at, 0
        return (opened, n + 1), (n < limit,)

    return in_order(stream, key, event, event, late, step, "allowed boolean")
