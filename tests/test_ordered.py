"""Streams in event time: events that arrive in any order give what the batch gives on the events in order."""

import random
from datetime import UTC, datetime, timedelta

from pelagos.operators import sequential
from pelagos.streaming import counts, ordered

START = datetime(2024, 1, 1, tzinfo=UTC)


def batches(spark, folder, rows, n):
    """Files that a stream reads one after the other, in the order of their names and times."""
    for i in range(n):
        df = spark.createDataFrame(rows[i::n] if n > 1 else rows, "user_id long, event_id long, ts timestamp, event_type string")
        df.coalesce(1).write.mode("append").parquet(str(folder))
    return df.schema


def events(rng, n):
    """Times within two hours by turns, so that a delay of a day holds all that is out of order; ties, nulls, repeated texts."""
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, START + timedelta(minutes=rng.randrange(600) // 5 * 5), rng.choice("aab")) for i in range(n)]
    rng.shuffle(rows)
    return rows + [(9, 10**6, START + timedelta(days=3), "end"), (None, 10**6 + 1, START, "x"), (1, 10**6 + 2, None, "x"), (2, 10**6 + 3, START + timedelta(minutes=1), None)]


def test_changes(spark, tmp_path):
    rows = events(random.Random(1), 120)
    schema = batches(spark, tmp_path / "in", rows[:-4], 3)
    batches(spark, tmp_path / "in", rows[-4:], 1)
    got = counts.drained(ordered.changes(counts.event_stream(spark, str(tmp_path / "in"), schema), "user_id", "event_id", "event_type", "1 day"), "changes-test").collect()
    want, last = [], {}
    for user, event, ts, text in sorted((r for r in rows if r[0] and r[2] and r[0] != 9), key=lambda r: (r[2], r[1])):
        if user in last and last[user] != text:
            want.append((user, event, last[user], text))
        last[user] = text
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 20


def test_limited_equals_the_batch(spark, tmp_path):
    rows = [r for r in events(random.Random(2), 150) if r[0] and r[2]]
    schema = batches(spark, tmp_path / "in", rows[:-2], 4)
    batches(spark, tmp_path / "in", rows[-2:], 1)
    stream = ordered.limited(counts.event_stream(spark, str(tmp_path / "in"), schema), "user_id", "event_id", 2, 3600.0, "1 day")
    got = {r["event_id"]: r["allowed"] for r in counts.drained(stream, "limited-test").collect()}
    df = spark.createDataFrame(rows, schema).where("user_id <> 9").select("event_id", "user_id", "ts")
    want = {r["event_id"]: r["allowed"] for r in sequential.allowed(df, "user_id", "ts", ["ts", "event_id"], 2, 3600.0).collect()}
    assert got == want and 10 < sum(want.values()) < len(want)


def test_what_the_watermark_has_not_passed_waits(spark, tmp_path):
    rows = [(1, 1, START, "a"), (1, 2, START + timedelta(hours=1), "b"), (1, 3, START + timedelta(days=1), "c")]
    schema = batches(spark, tmp_path / "in", rows, 1)
    got = counts.drained(ordered.changes(counts.event_stream(spark, str(tmp_path / "in"), schema), "user_id", "event_id", "event_type", "10 hours"), "waits").collect()
    assert [tuple(r) for r in got] == [(1, 2, "a", "b")]
