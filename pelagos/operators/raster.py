"""Polygons, lines and ways on cells: filling, buffers, borders, straightened paths and searches in a corridor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.geo import segment_distance
from pelagos.operators.graph import grid_costs
from pelagos.sources.scratch import written


def _centres(low: Column, high: Column, size: float) -> Column:
    """Numbers of the cells whose centre is in [low, high): none where there is no such cell."""
    near = F.sequence(F.ceil(low / size - 0.5) - 1, F.ceil(high / size - 0.5))  # one more at each end, for what division rounds
    centre = lambda n: (n + 0.5) * size
    return F.when(low < high, F.filter(near, lambda n: (centre(n) >= low) & (centre(n) < high)))


def fill(edges: DataFrame, size: float) -> DataFrame:
    """``id``, ``r``, ``c`` of the cells whose centre is within a polygon, by its ``edges`` (``id``, ``x1``, ``y1``, ``x2``, ``y2``).

    Each edge meets the rows of centres that it crosses; a row's crossings in order open and close intervals of
    columns (even-odd rule, so holes and several rings are edges like any other). Left and lower borders belong to
    the polygon, right and upper ones do not. Rows follow the outline and the area, not the bounding box.
    """
    y = (F.col("r") + 0.5) * size
    rows = edges.withColumn("r", F.explode(_centres(F.least("y1", "y2"), F.greatest("y1", "y2"), size)))
    crossed = rows.select("id", "r", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    along = Window.partitionBy("id", "r").orderBy("x")
    spans = crossed.withColumns({"k": F.row_number().over(along), "to": F.lead("x").over(along)}).where("k % 2 = 1")
    return spans.select("id", "r", F.explode(_centres(F.col("x"), F.col("to"), size)).alias("c"))


def _beside(lines: DataFrame, distance: float, size: float) -> DataFrame:
    """``lines`` with ``r``, ``c`` of the cells whose centre is within ``distance`` of the segment.

    In each row only the columns beside the part of the segment that lies within the distance of it are tried.
    """
    rows = lines.withColumn("r", F.explode(_centres(F.least("y1", "y2") - distance, F.greatest("y1", "y2") + distance + size, size)))
    y = (F.col("r") + 0.5) * size
    share = lambda at: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("y1")) / (F.col("y2") - F.col("y1"))))
    x_at = lambda at: F.when(F.col("y1") == F.col("y2"), None).otherwise(F.col("x1") + share(at) * (F.col("x2") - F.col("x1")))
    a, b = F.coalesce(x_at(y - distance), "x1"), F.coalesce(x_at(y + distance), "x2")
    cells = rows.withColumn("c", F.explode(_centres(F.least(a, b) - distance - size, F.greatest(a, b) + distance + size, size)))
    d = segment_distance((F.col("c") + 0.5) * size, y, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return cells.where(d <= distance)


def near_lines(lines: DataFrame, distance: float, size: float) -> DataFrame:
    """``id``, ``r``, ``c`` of the cells whose centre is within ``distance`` of a segment of ``lines`` (``id``, ``x1``, ``y1``, ``x2``, ``y2``)."""
    return _beside(lines, distance, size).select("id", "r", "c").distinct()


def mask(edges: DataFrame, distance: float, size: float) -> DataFrame:
    """``r``, ``c`` of the cells within any polygon whose centre is not within ``distance`` of any outline.

    Both kinds of cells are grouped together, each task's first: how many cells polygons have is not seen by sizes of
    files, so that a join could have them all sent through the driver, and a small file's edges are dealt out for it.
    Sides that outlines have in common are looked at once.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = ["x1", "y1", "x2", "y2"]
    held = fill(edges.repartition(parts, "id", *side), size).select("r", "c", F.lit(False).alias("near"))
    beside = _beside(edges.select(side).repartition(parts, *side).distinct(), distance, size).select("r", "c", F.lit(True))
    return held.union(beside).groupBy("r", "c").agg(F.bool_or("near").alias("near")).where("not near").select("r", "c")


def border_cells(edges: DataFrame, distance: float, size: float) -> DataFrame:
    """``id``, ``gap``, ``single``, ``overlap``: of the cells within ``distance`` of a polygon's outline, how many lie in no, one or several polygons."""
    held = fill(edges, size).distinct().groupBy("r", "c").agg(F.count("*").alias("n"))
    band = near_lines(edges, distance, size).join(held, ["r", "c"], "left")
    n = F.coalesce("n", F.lit(0))
    return band.groupBy("id").agg(F.count_if(n == 0).alias("gap"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("overlap"))


def _leg_cells(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """The cells of a straight leg, one for each step along its longer side, rounded half up."""
    steps = F.greatest(F.lit(1), F.abs(r1 - r0), F.abs(c1 - c0)).cast("int")
    at = lambda a, b, t: F.floor(a + (b - a) * t + 0.5)
    return F.transform(F.sequence(F.lit(0), steps), lambda s: F.struct(at(r0, r1, s / steps).alias("r"), at(c0, c1, s / steps).alias("c")))


def farthest_seen(path: DataFrame, blocked: DataFrame) -> DataFrame:
    """``route``, ``seq``, ``far``: the last point before the first one that a straight leg from ``seq`` does not reach over free cells.

    ``path``: ``route``, ``seq`` (0, 1, ...), ``r``, ``c``. ``blocked``: ``r``, ``c``. The next point always counts as
    reached. Points look ahead twice as far in each round while they see all, so work follows what is seen.
    """
    last = path.groupBy("route").agg(F.max("seq").alias("last"))
    looking = written(path.join(last, "route").select("route", "seq", "r", "c", "last", F.least(F.lit(1), F.col("last") - F.col("seq")).cast("long").alias("span")), "looking")
    ends = path.select("route", F.col("seq").alias("k"), F.col("r").alias("r1"), F.col("c").alias("c1"))
    walls = blocked.select("r", "c").distinct()
    done = None
    while True:
        over = looking.where("seq + span >= last").select("route", "seq", F.col("last").alias("far"))
        looking = looking.where("seq + span < last")
        legs = looking.withColumn("k", F.explode(F.sequence(F.col("seq") + F.col("span") + 1, F.least("last", F.col("seq") + 2 * F.col("span")))))
        cells = legs.join(ends, ["route", "k"]).select("route", "seq", "k", F.explode(_leg_cells(F.col("r"), F.col("c"), F.col("r1"), F.col("c1"))).alias("x"))
        hit = cells.select("route", "seq", "k", "x.r", "x.c").join(walls, ["r", "c"], "left_semi").groupBy("route", "seq").agg(F.min("k").alias("hit"))
        after = written(looking.join(hit, ["route", "seq"], "left"), "looked")
        found = over.union(after.where("hit is not null").select("route", "seq", (F.col("hit") - 1).alias("far")))
        done = found if done is None else done.union(found)
        looking = after.where("hit is null").withColumn("span", F.least(2 * F.col("span"), F.col("last") - F.col("seq"))).drop("hit")
        if looking.isEmpty():
            return done


def string_pull(path: DataFrame, blocked: DataFrame) -> DataFrame:
    """``route``, ``seq`` of the points that a path keeps: from the first on, each time the farthest one that is seen (see ``farthest_seen``).

    The chain is found by pointer jumping: points kept so far mark those that double as many jumps reach.
    """
    jump = written(farthest_seen(path, blocked).where("far > seq"), "jumps")
    kept, n = path.where("seq = 0").select("route", "seq"), -1
    while True:
        onward = kept.join(jump, ["route", "seq"]).select("route", F.col("far").alias("seq"))
        kept = written(kept.union(onward).distinct(), "kept")
        now = kept.count()
        if now == n:
            return kept
        n = now
        farther = jump.select("route", F.col("seq").alias("far"), F.col("far").alias("to"))
        jump = written(jump.join(farther, ["route", "far"], "left").select("route", "seq", F.coalesce("to", "far").alias("far")), "jumps")


def corridor(cells: DataFrame, start: DataFrame, goal: DataFrame, factor: int, radius: int, tile: int = 64) -> DataFrame:
    """Those of ``cells`` (``r``, ``c``, ``w``) near the best ways over blocks of ``factor`` by ``factor`` cells, priced by their cheapest cell.

    Costs from both ends tell which blocks lie on a best way; blocks within ``radius`` of these make the corridor.
    """
    up = lambda df: df.select(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c"), *[x for x in df.columns if x == "w"])
    blocks = written(up(cells).groupBy("r", "c").agg(F.min("w").alias("w")), "blocks")
    there = grid_costs(blocks, up(start), tile).withColumnRenamed("cost", "there")
    back = grid_costs(blocks, up(goal), tile).withColumnRenamed("cost", "back")
    through = written(blocks.join(there, ["r", "c"]).join(back, ["r", "c"]).select("r", "c", (F.col("there") + F.col("back") - F.col("w")).alias("total")), "through")
    best = through.join(through.agg(F.min("total").alias("total")), "total")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)))).alias("s")
    wide = best.select("r", "c", around).select((F.col("r") + F.col("s.i")).alias("br"), (F.col("c") + F.col("s.j")).alias("bc")).distinct()
    return cells.join(wide, (F.floor(F.col("r") / factor) == F.col("br")) & (F.floor(F.col("c") / factor) == F.col("bc"))).drop("br", "bc")


def corridor_cost(cells: DataFrame, start: DataFrame, goal: DataFrame, factor: int = 8, radius: int = 1, tile: int = 64) -> DataFrame:
    """One row ``cost``, ``via``, ``opened``: the least cost within the corridor, or of the free search where the corridor holds no way.

    ``via`` is ``corridor``, ``free``, or null without any way; ``opened`` tells how many cells the search could enter. The cost of a
    corridor is that of the best way of all where this lies in it, and never lower.
    """
    inside = written(corridor(cells, start, goal, factor, radius, tile), "corridor")
    for via, some in (("corridor", inside), ("free", cells)):
        found = written(grid_costs(some, start, tile).join(goal.select("r", "c").distinct(), ["r", "c"]).agg(F.min("cost").alias("cost")), "goal")
        if not found.where("cost is not null").isEmpty():
            return found.crossJoin(some.agg(F.count("*").alias("opened"))).select("cost", F.lit(via).alias("via"), "opened")
    return found.select("cost", F.lit(None).cast("string").alias("via"), F.lit(0).cast("bigint").alias("opened"))
