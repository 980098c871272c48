"""Waters beside a crossing, their widths, and zones that reach a place: bounded floods from many seeds, runs along axes, distances to buffered points and lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.geo import segment_distance
from pelagos.operators.raster import near_lines


def seeds_near(anchors: DataFrame, water: DataFrame, radius: int, excluded: DataFrame) -> DataFrame:
    """``id``, ``r``, ``c``: for each anchor (``id``, ``r``, ``c``) the first cell of ``water`` (``r``, ``c``) on the rings around it, 1 to ``radius``.

    On a ring the lower row comes first, then the lower column. Cells ``excluded`` (``id``, ``r``, ``c``) for an anchor
    are none. Anchors without water in reach have no row.
    """
    k = range(-radius, radius + 1)
    around = F.explode(F.array(*(F.struct(F.lit(max(abs(i), abs(j))).alias("ring"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in k for j in k if i or j))).alias("s")
    tried = anchors.select("id", "r", "c", around).select("id", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), "s")
    found = tried.join(water.select("r", "c"), ["r", "c"], "left_semi").join(excluded.select("id", "r", "c"), ["id", "r", "c"], "left_anti")
    first = found.groupBy("id").agg(F.min(F.struct("s.ring", "s.i", "s.j", "r", "c")).alias("x"))
    return first.select("id", "x.r", "x.c")


def _flood(side: int, bound: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        free = np.zeros((side + 2, side + 2), bool)
        for cells in rows["cells"]:
            free[np.asarray(cells) // side + 1, np.asarray(cells) % side + 1] = True
        for cells in rows["out"]:
            free[np.asarray(cells, np.int64) // side + 1, np.asarray(cells, np.int64) % side + 1] = False
        r, c = int(rows["sr"].iloc[0]) + 1, int(rows["sc"].iloc[0]) + 1
        seen = np.zeros_like(free)
        inside = 0 <= r <= side + 1 and 0 <= c <= side + 1
        if inside:
            seen[r, c] = free[r, c]
        size = int(inside and seen[r, c])
        while 0 < size < bound:
            wide = seen.copy()
            wide[1:] |= seen[:-1]
            wide[:-1] |= seen[1:]
            seen = wide.copy()
            seen[:, 1:] |= wide[:, :-1]
            seen[:, :-1] |= wide[:, 1:]
            seen &= free
            now = int(seen.sum())
            if now == size:
                break
            size = now
        return pd.DataFrame({"id": rows["id"].iloc[:1], "size": [min(size, bound)], "bounded": [size >= bound]})

    return run


def bounded_waters(water: DataFrame, seeds: DataFrame, margin: int, bound: int, excluded: DataFrame) -> DataFrame:
    """``id``, ``size``, ``bounded``: how many cells of ``water`` (``r``, ``c``) eight steps join to a seed, counted up to ``bound``.

    ``seeds``: ``id`` (unique), ``r``, ``c`` and the centre ``r0``, ``c0`` of a window that ends ``margin`` cells away from it;
    cells outside it and those ``excluded`` (``id``, ``r``, ``c``) are not entered. A seed that is no water has size zero.
    All waters of ``bound`` cells or more are alike: size ``bound``, ``bounded`` true.

    Water travels as blocks of the window's width, each one row with its cells, so a seed meets at most four blocks,
    whatever the table holds, and a task holds one window at a time.
    """
    side = 2 * margin + 1
    block = lambda x: F.floor(F.col(x) / side)
    blocks = water.select("r", "c").distinct().groupBy(block("r").alias("br"), block("c").alias("bc")).agg(F.collect_list(F.struct("r", "c")).alias("all"))
    low = seeds.select("id", (F.col("r0") - margin).alias("r1"), (F.col("c0") - margin).alias("c1"), (F.col("r") - F.col("r0") + margin).alias("sr"), (F.col("c") - F.col("c0") + margin).alias("sc"))
    four = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("s")
    asked = low.select("*", four).withColumns({"br": block("r1") + F.col("s.i"), "bc": block("c1") + F.col("s.j")}).drop("s")
    of = lambda cells: F.transform(
        F.filter(cells, lambda x: x["r"].between(F.col("r1"), F.col("r1") + side - 1) & x["c"].between(F.col("c1"), F.col("c1") + side - 1)),
        lambda x: (x["r"] - F.col("r1")) * side + x["c"] - F.col("c1"),
    )
    none = F.array().cast("array<bigint>")
    parts = asked.join(blocks, ["br", "bc"], "left").select("id", "sr", "sc", F.coalesce(of(F.col("all")), none).alias("cells"))
    shut = excluded.join(low, "id").where("r between r1 and r1 + {0} and c between c1 and c1 + {0}".format(side - 1)).distinct()
    shut = shut.groupBy("id").agg(F.collect_list((F.col("r") - F.col("r1")) * side + F.col("c") - F.col("c1")).alias("out"))
    parts = parts.join(shut, "id", "left").withColumn("out", F.coalesce("out", none))
    return parts.groupBy("id").applyInPandas(_flood(side, bound), "id long, size long, bounded boolean")


def least_widths(water: DataFrame, reach: int = 40) -> DataFrame:
    """``r``, ``c``, ``width``: steps from a cell of ``water`` (``r``, ``c``) to the first cell on either side that is none, added, on the narrowest of four axes.

    No side counts for more than ``reach`` steps. On each axis (row, column, two diagonals) the cells of a line form
    runs without gaps, and a cell's steps are those to the ends of its run: one shuffle by line, one back to cells.
    """
    r, c = F.col("r"), F.col("c")
    lines = ((F.lit(0).cast("long"), r, c), (F.lit(1).cast("long"), c, r), (F.lit(2).cast("long"), r - c, r), (F.lit(3).cast("long"), r + c, r))
    axes = F.explode(F.array(*(F.struct(axis.alias("axis"), line.cast("long").alias("line"), at.cast("long").alias("at")) for axis, line, at in lines))).alias("x")
    along = water.select("r", "c").distinct().select("r", "c", axes).select("r", "c", "x.*")
    runs = along.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("axis", "line").orderBy("at")))
    run = Window.partitionBy("axis", "line", "run")
    ahead, back = F.max("at").over(run) - F.col("at") + 1, F.col("at") - F.min("at").over(run) + 1
    sides = runs.withColumns({"ahead": ahead, "back": back})
    wide = F.least(F.lit(reach).cast("long"), "ahead") + F.least(F.lit(reach).cast("long"), "back")
    return sides.groupBy("r", "c").agg(F.min(wide).alias("width"))


def zones_reaching(points: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """``id``, ``zone``, ``distance``, ``place``: the zones whose buffer reaches a point, the nearest first (``place`` 1; ties by zone).

    ``points``: ``id``, ``x``, ``y``. ``zones``: ``zone``, ``x1``, ``y1``, ``x2``, ``y2``, ``buffer``, a row a segment, a point
    being a segment of no length. A segment meets the points of the cells (``size`` wide) along it, so work follows its
    length and buffer, not its bounding box.
    """
    reach = F.col("buffer") + size * 0.7072  # half a cell's diagonal
    parts = zones.where("buffer >= 0").withColumn("id", F.struct("zone", "x1", "y1", "x2", "y2", "buffer"))
    cells = near_lines(parts, reach, size).select("r", "c", "id.*")
    placed = points.select("id", "x", "y", F.floor(F.col("y") / size).alias("r"), F.floor(F.col("x") / size).alias("c"))
    met = placed.join(cells, ["r", "c"]).withColumn("d", segment_distance(*(F.col(k) for k in ("x", "y", "x1", "y1", "x2", "y2"))))
    best = met.where("d <= buffer").groupBy("id", "zone").agg(F.min("d").alias("distance"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("distance", "zone")))
