"""Tables in versions: written by cells of the map, held against controls as they stand on disk, then published by a pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from pelagos.operators import raster
from pelagos.operators import spatial as S

#: A control gets the table as written and gives one row: ``ok``, ``got``.
Control = Callable[[DataFrame], DataFrame]


def _interleaved(x: Column, y: Column, bits: int = 16) -> Column:
    """The bits of two whole numbers in turn: places near each other mostly have numbers near each other."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return out


def write_by_cells(df: DataFrame, to: str, x: Column, y: Column, size: float, files: int) -> None:
    """Writes rows in folders of cells ``by``, ``bx`` (degrees over ``size``); rows of one file lie near each other.

    Ranges of a space-filling key make about ``files`` parts of even size, so that a crowded cell has several files
    and no task more than its part. Rows without a place are in the cell of no number.
    """
    fine = lambda v, low: F.floor((v - low) / 360 * 65_535).cast("long")
    placed = df.withColumns({"by": F.floor(y / size).cast("int"), "bx": F.floor(x / size).cast("int"), "_z": _interleaved(fine(x, -180), fine(y, -180)), "_n": F.xxhash64(*df.columns)})
    placed.repartitionByRange(files, "_z", "_n").sortWithinPartitions("by", "bx", "_z").drop("_z", "_n").write.partitionBy("by", "bx").parquet(to)


def _read(spark: SparkSession, path: str, version: str, columns: StructType) -> DataFrame:
    cells = StructType(columns.fields).add("by", IntegerType()).add("bx", IntegerType())
    return spark.read.schema(cells).parquet(f"{path}/versions/{version}")


def _version(spark: SparkSession, path: str) -> tuple[int, str, StructType] | None:
    try:
        last = spark.read.schema("place long, version string, columns string").parquet(f"{path}/published").agg(F.max(F.struct("place", "version", "columns")).alias("x")).first()["x"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (last["place"], last["version"], StructType.fromJson(json.loads(last["columns"]))) if last else None


def publish(df: DataFrame, path: str, x: Column, y: Column, size: float, controls: dict[str, Control], files: int = 64) -> DataFrame:
    """Writes a new version below ``path`` and makes it the one that ``published`` reads if all controls hold on what was written.

    Returns ``control``, ``ok``, ``got``. A control without an answer (null) does not hold. A version that fails stays
    unread beside the last good one. The pointer is one row added after the files are complete, so whoever reads sees
    the old or the new version, whole.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    write_by_cells(df, f"{path}/versions/{version}", x, y, size, files)
    stands = _read(spark, path, version, df.schema).drop("by", "bx")
    found = [(name, *run(stands).select("ok", F.col("got").cast("string")).first()) for name, run in controls.items()]
    out = spark.createDataFrame([(name, bool(ok), got) for name, ok, got in found], "control string, ok boolean, got string")
    if all(ok for _, ok, _ in found):
        before = _version(spark, path)
        pointer = spark.range(1).select(F.lit(before[0] + 1 if before else 0).cast("long").alias("place"), F.lit(version).alias("version"), F.lit(df.schema.json()).alias("columns"))
        pointer.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return out


def published(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, size: float | None = None) -> DataFrame:
    """The published version; with ``box`` (x1, y1, x2, y2) and the ``size`` it was written with only the folders of the cells in it are read."""
    now = _version(spark, path)
    if now is None:
        raise ValueError(f"nothing is published at {path}")
    df = _read(spark, path, *now[1:])
    if box:
        x1, y1, x2, y2 = (int(v // size) for v in box)
        df = df.where(F.col("bx").between(x1, x2) & F.col("by").between(y1, y2))
    return df.drop("by", "bx")


def as_read(rows: int, columns: list[str]) -> Control:
    """As many rows as the source had, none with a null or a number that is none in ``columns``."""
    broken = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    bad = lambda: F.array_contains(F.array(*(broken(c) for c in columns)), True)
    got = lambda: F.format_string("%d rows, %d broken", F.count("*"), F.count_if(bad()))
    return lambda t: t.agg(((F.count("*") == rows) & (F.count_if(bad()) == 0)).alias("ok"), got().alias("got"))


def covers(points: DataFrame) -> Control:
    """All ``points`` (``x``, ``y``), and there are some, lie in the box of the edges ``x1``, ``y1``, ``x2``, ``y2``."""

    def run(t: DataFrame) -> DataFrame:
        box = t.agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"), F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
        met = points.join(F.broadcast(box), how="cross")  # one row
        inside = F.col("x").between(F.col("a"), F.col("b")) & F.col("y").between(F.col("c"), F.col("d"))
        return met.agg(((F.count("*") > 0) & (F.count_if(inside) == F.count("*"))).alias("ok"), F.format_string("%d of %d points in the box", F.count_if(inside), F.count("*")).alias("got"))

    return run


def overlaps_as_declared(disjoint: bool, size: float) -> Control:
    """Polygons (edges by ``id``) lap over each other, told by the centres of cells ``size`` wide, only if they do not declare to be ``disjoint``, and then they do."""

    def run(t: DataFrame) -> DataFrame:
        shared = raster.fill(t, size).distinct().groupBy("r", "c").count().agg(F.count_if(F.col("count") > 1).alias("n"))
        return shared.select(((F.col("n") == 0) == F.lit(disjoint)).alias("ok"), F.format_string("%d cells in several polygons", "n").alias("got"))

    return run


def denser(other: int, times: float) -> Control:
    """At least ``times`` as many edges as the ``other`` layer has, which has some."""
    return lambda t: t.agg((F.lit(other > 0) & (F.count("*") >= other * times)).alias("ok"), F.format_string("%d against %d edges", F.count("*"), F.lit(other)).alias("got"))


def holds(points: DataFrame, width: float) -> Control:
    """Each of the ``points`` (``id``, ``x``, ``y``), and there are some, lies in a polygon (edges by ``id``)."""

    def run(t: DataFrame) -> DataFrame:
        inside = S.points_in_polygons(points.select("id", "x", "y"), t.withColumnRenamed("id", "polygon"), width).select("id").distinct()
        met = points.select("id").distinct().join(inside.withColumn("in", F.lit(1)), "id", "left")
        return met.agg(((F.count("*") > 0) & (F.count("in") == F.count("*"))).alias("ok"), F.format_string("%d of %d points inside", F.count("in"), F.count("*")).alias("got"))

    return run
