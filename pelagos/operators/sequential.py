"""Computations that go through each key's rows in order, with a state that stays small."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def scan(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, out: str, out_type: T.DataType) -> DataFrame:
    """``rows`` with a column that ``step(state, row)`` gives, called per key in order; it returns the next state and the value.

    Rows are dealt by key and sorted within partitions, so a task streams through them and holds one state;
    however many rows a key has, none are gathered.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    schema = T.StructType([*rows.schema, T.StructField(out, out_type)])

    def run(batches):
        seen, state = object(), None
        for b in batches:
            values = []
            for row in b.to_pylist():
                if row[key] != seen:
                    seen, state = row[key], start()
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values)], names=[*b.schema.names, out])

    return dealt.mapInArrow(run, schema)


def allowed(requests: DataFrame, key: str, time: str, order: list[str], limit: int, seconds: float) -> DataFrame:
    """``requests`` with ``allowed``: the first ``limit`` of each window; a window opens with the first request after the last one closed."""

    def step(state, row):
        opened, n = state
        if opened is None or (row[time] - opened).total_seconds() >= seconds:
            opened, n = row[time], 0
        return (opened, n + 1), n < limit

    return scan(requests, key, order, lambda: (None, 0), step, "allowed", T.BooleanType())


def breaker(calls: DataFrame, key: str, time: str, failed: str, order: list[str], failures: int = 5, seconds: float = 60.0) -> DataFrame:
    """``calls`` with the ``state`` each meets: CLOSED; OPEN for a while after so many failures in a row; then one HALF_OPEN trial decides."""

    def step(state, row):
        n, opened = state
        if opened is not None and (row[time] - opened).total_seconds() < seconds:
            return (n, opened), "OPEN"
        trial = opened is not None
        if row[failed]:
            n += 1
            opened = row[time] if trial or n >= failures else None
        else:
            n, opened = 0, None
        return (n, opened), "HALF_OPEN" if trial else "CLOSED"

    return scan(calls, key, order, lambda: (0, None), step, "state", T.StringType())
