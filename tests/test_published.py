"""Versions by cells: what a box reads, what a failed control leaves, each control on good and bad edges."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pelagos.sources import published as P


def square(k, x, y, w):
    p = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    return [(k, *map(float, a), *map(float, b)) for a, b in zip(p, p[1:] + p[:1], strict=True)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")


def test_a_box_reads_its_folders_only(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.uniform(-80, -70), rng.uniform(-50, -20)) for k in range(2000)] + [(9000 + k, -75.5, -30.5) for k in range(3000)] + [(9999999, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    path = str(tmp_path / "t")
    assert all(r["ok"] for r in P.publish(df, path, F.col("x"), F.col("y"), 2.0, {"A4": P.as_read(5001, ["id"])}, 16).collect())
    assert sorted(r["id"] for r in P.published(spark, path).collect()) == sorted(r[0] for r in rows)
    crowded = list(Path(path).glob("versions/*/by=-16/bx=-38/*.parquet"))
    assert len(crowded) > 3  # a third of all rows and more in one place are several files
    for file in Path(path).glob("versions/*/by=*/bx=*/*.parquet"):
        if not (file.parts[-3] in ("by=-16", "by=-15") and file.parts[-2] == "bx=-38"):
            file.write_bytes(b"not read")
    got = P.published(spark, path, (-76.0, -31.0, -75.0, -29.0), 2.0).where("x between -76 and -75 and y between -31 and -29")
    assert sorted(r["id"] for r in got.collect()) == sorted(k for k, x, y in rows if x is not None and -76 <= x <= -75 and -31 <= y <= -29)


def test_a_failed_control_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing is published"):
        P.published(spark, path)
    put = lambda rows, n: P.publish(edges(spark, rows), path, F.col("x1"), F.col("y1"), 1.0, {"A4": P.as_read(n, ["x1"]), "none": lambda t: t.agg(F.lit(True).alias("ok"), F.lit("").alias("got"))}, 2)
    assert [r["ok"] for r in put(square(1, 0, 0, 1), 5).collect()] == [False, True]
    with pytest.raises(ValueError, match="nothing is published"):
        P.published(spark, path)
    for k in (1, 2):
        put(square(k, 0, 0, 1), 4)
        assert {r["id"] for r in P.published(spark, path).collect()} == {k}
    assert put(square(3, 0, 0, 1), 7).first()["got"] == "4 rows, 0 broken"
    assert {r["id"] for r in P.published(spark, path).collect()} == {2}


def test_controls(spark):
    apart, over = edges(spark, square(1, 0, 0, 2) + square(2, 3, 0, 2)), edges(spark, square(1, 0, 0, 2) + square(2, 1, 0, 2))
    point = lambda *rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double")
    nan = edges(spark, [*square(1, 0, 0, 2), (2, math.nan, 0.0, 1.0, 1.0)])
    for control, table, ok in [
        (P.as_read(8, ["x1", "y2"]), apart, True), (P.as_read(8, ["x1"]), nan, False), (P.as_read(5, ["x1"]), nan, False), (P.as_read(0, ["x1"]), apart.where("false"), True),
        (P.covers(point((0, 0), (4.9, 1))), apart, True), (P.covers(point((0, 0), (5.1, 1))), apart, False), (P.covers(point((0, 0)).where("false")), apart, False), (P.covers(point((0, 0))), apart.where("false"), False),
        (P.overlaps_as_declared(True, 0.25), apart, True), (P.overlaps_as_declared(False, 0.25), apart, False), (P.overlaps_as_declared(True, 0.25), over, False), (P.overlaps_as_declared(False, 0.25), over, True),
        (P.denser(2, 4), apart, True), (P.denser(2, 4.5), apart, False), (P.denser(0, 1), apart, False),
        (P.holds(point((1, 1), (4, 1)), 0.5), apart, True), (P.holds(point((1, 1), (2.5, 1)), 0.5), apart, False), (P.holds(point((1, 1)).where("false"), 0.5), apart, False),
    ]:
        rows = control(table).collect()
        assert len(rows) == 1 and rows[0]["ok"] is ok, (control, rows)
