"""Where operators keep what later steps read again."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and Spark runs in one process, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


#: Rows of one Arrow batch: texts of some kilobytes each, so a Python worker holds a few megabytes at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has texts come to Python in small batches, unless the session sets a size other than Spark's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        top = LOCAL_CHECKPOINTS
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it the files that a query shuffled are deleted when it has ended, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str, lean: bool = False, by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there.

    ``lean``: with ``lean_shuffles``. ``by``: in folders by these columns, which can be discarded one by one.
    """
    path = shared_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    with lean_shuffles(df.sparkSession) if lean else nullcontext():
        df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Bucketed:
    """A table in the shared folder, dealt by ``key`` into ``buckets``: what is dealt alike meets it without a shuffle of it."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path, self.table = shared_path(spark, name), f"{name}_{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> None:
        small_batches(self.spark)
        out = rows.repartition(self.buckets, self.key).write.option("compression", "zstd").option("path", self.path)
        with lean_shuffles(self.spark):
            out.bucketBy(self.buckets, self.key).mode("append").format("parquet").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table).withMetadata(self.key, {"table": self.table})


def drop_bucketed(df: DataFrame) -> None:
    """Drops a table that ``Bucketed`` gave, and its files, as ``discard`` does."""
    name = next(m["table"] for m in (f.metadata for f in df.schema.fields) if "table" in m)
    discard(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def discard(df: DataFrame, part: str = "") -> None:
    """Deletes the files of a table that ``stored`` gave, or those of its folder ``part``. Only for what nothing reads any more: what was made of it must be stored itself."""
    spark = df.sparkSession
    for path in {file.rpartition("/")[0] for file in df.inputFiles() if f"{part}/" in file}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of up to some hundred bytes that are sent to all tasks rather than joined by a shuffle of the texts.
SMALL_ROWS = 300_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has been counted to be small; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_row_key(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``_id`` (the key as text; null has a value of its own) and ``_th`` (a hash of the text).

    Rows equal in both are one document: every operator gives them the same result.
    """
    return docs.withColumns({
        "_id": F.coalesce(F.col(key).cast("string"), F.lit("~")),
        "_th": F.xxhash64(F.col(text)),
    })
