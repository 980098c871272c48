"""Event streams: windowed counts, late data, anchored rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pelagos.sources.scratch import path


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder or glob as a stream; ``ts`` becomes an instant."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there and returns what it wrote to the shared folder."""
    spark = stream.sparkSession
    to, state = path(spark, name), path(spark, name + "-state")
    query = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(to)


def tumbling(stream: DataFrame, late: str = "2 days", width: str = "15 minutes") -> DataFrame:
    """Counts by window and type; events later than ``late`` do not count, windows come out once they are closed."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def limited(stream: DataFrame, limit: int, seconds: float) -> DataFrame:
    """``user_id``, ``event_id``, ``allowed``: the first ``limit`` events of windows that open with a key's first event after the last window.

    The state of a key is one instant and one count.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        out = []
        for at, event in zip(rows["ts"], rows["event_id"], strict=True):
            now = at.timestamp()
            if opened is None or now - opened >= seconds:
                opened, n = now, 0
            out.append((key[0], event, n < limit))
            n += 1
        state.update((opened, n))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return stream.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, allowed boolean", "opened double, n long", "append", GroupStateTimeout.NoTimeout
    )
