"""Joins by distance and geometry without cross joins: places meet through the cells of a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import geo
from pelagos.sources.scratch import written

#: Kilometres of a degree of latitude, a little less than any, so that cells never miss a place.
_KM_PER_DEGREE = 110.5


def _cells(x: Column, width: float, reach: int) -> Column:
    c = F.floor(x / width)
    return F.explode(F.sequence(c - reach, c + reach))


def radius_join(left: DataFrame, right: DataFrame, km: float, radius: float = geo.RADIUS_KM) -> DataFrame:
    """All pairs within ``km``: columns ``id``, ``lat``, ``lng`` on both sides; returns ``id``, ``other``, ``km``.

    Latitudes are cut into bands as high as the radius, so a place looks at three; longitudes into cells as wide
    as the radius is at the band's farthest latitude from the equator. Places near meridian 180 are also looked for
    one turn farther on.
    """
    high = km / _KM_PER_DEGREE
    # the widest a radius gets in longitude is at the pole side of the outermost band that it reaches
    wide = lambda band: high / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(band), F.abs(band + 1)) * high + high, F.lit(89.0)))), F.lit(0.01))
    a = left.select(F.col("id"), F.col("lat"), F.col("lng"), _cells(F.col("lat"), high, 1).alias("band"))
    a = a.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lng") / wide(F.col("band"))) - 1, F.floor(F.col("lng") / wide(F.col("band"))) + 1)))
    b = right.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.floor(F.col("lat") / high).alias("band"))
    edge = 180.0 - wide(F.col("band"))
    turns = F.when(F.col("lng2") > edge, F.array(F.col("lng2"), F.col("lng2") - 360)).when(F.col("lng2") < -edge, F.array(F.col("lng2"), F.col("lng2") + 360)).otherwise(F.array("lng2"))
    b = b.withColumn("x", F.explode(turns)).withColumn("cell", F.floor(F.col("x") / wide(F.col("band")))).drop("x")
    d = geo.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"), radius)
    return a.join(b, ["band", "cell"]).withColumn("km", d).where(F.col("km") <= km).select("id", "other", "km")


def within(left: DataFrame, right: DataFrame, km: float, radius: float = geo.RADIUS_KM) -> DataFrame:
    """Per ``id`` the nearest ``other`` within the distance, of all pairs that far apart at most."""
    near = radius_join(left, right, km, radius)
    return near.groupBy("id").agg(F.min(F.struct("km", "other")).alias("m")).select("id", "m.other", "m.km")


def nearest(left: DataFrame, right: DataFrame, within_km: float, radius: float = geo.RADIUS_KM, first_km: float | None = None) -> DataFrame:
    """Per ``id`` the nearest ``other`` within the distance, ties to the smaller id. Places with none have no row.

    A first look goes a fifth as far (``first_km``); only places that have no answer there look on, so in dense parts
    few of the pairs within the distance are formed.
    """
    close = written(within(left, right, first_km or within_km / 5, radius), "nearest")
    return close.union(within(left.join(close, "id", "left_anti"), right, within_km, radius))


def _first_look(sites: DataFrame, within_km: float) -> float:
    """Kilometres, ``within_km`` at most, within which sites have a few others: as many as there are in the cells that they lie in, not in the mean cell."""
    km = within_km
    while True:
        high = km / _KM_PER_DEGREE
        cells = sites.groupBy(F.floor(F.col("lat") / high), F.floor(F.col("lng") * F.cos(F.radians("lat")) / high)).agg(F.count("*").cast("double").alias("n"))
        crowd = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
        if crowd <= 16:
            return km
        km *= (8 / (math.pi * crowd)) ** 0.5


def _two(seats: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """Per ``lat``, ``lng`` of ``seats`` the nearest of ``sites`` within the distance, ``km`` to it and to the next (``second``, null if there is none)."""
    a = seats.select(F.struct("lat", "lng").alias("id"), "lat", "lng")
    b = sites.select(F.struct("other", "several").alias("id"), "lat", "lng")
    w = W.Window.partitionBy("lat", "lng").orderBy("km", "other")
    pairs = radius_join(a, b, km).select("id.*", "other.*", "km").withColumns({"k": F.row_number().over(w), "next": F.lead("km").over(w)})
    return pairs.where("k = 1").select("lat", "lng", "other", "km", F.when(F.col("several"), F.col("km")).otherwise(F.col("next")).alias("second"))


def nearest_two(left: DataFrame, right: DataFrame, within_km: float) -> DataFrame:
    """Per ``id`` the nearest place, its distance and that of the next (null if there is none).

    Places at one point are looked for and looked at once. The first look goes as far as a few places are, by how
    crowded they lie; points that have two there are done, the others look three times as far each time, so in dense
    parts few of the pairs within the distance are formed.
    """
    seats = written(left.select("lat", "lng").distinct(), "seats")
    sites = written(right.groupBy("lat", "lng").agg(F.min("id").alias("other"), (F.count("*") > 1).alias("several")), "sites")
    found, km = None, _first_look(sites, within_km)
    while km * 2 < within_km:
        close = written(_two(seats, sites, km).where("second is not null"), "nearest")
        seats = seats.join(close, ["lat", "lng"], "left_anti")
        found = close if found is None else found.union(close)
        km *= 3
    last = _two(seats, sites, within_km)
    found = last if found is None else found.union(last)
    # an id at several points has the two nearest of all of them
    w = W.Window.partitionBy("id").orderBy("km", "other")
    ranked = left.select("id", "lat", "lng").join(found, ["lat", "lng"]).withColumns({"k": F.row_number().over(w), "second": F.least("second", F.lead("km").over(w))})
    return ranked.where("k = 1").select("id", "other", "km", "second")


def overlapping(intervals: DataFrame, group: str) -> DataFrame:
    """Pairs ``a`` < ``b`` of a group's intervals (``id``, ``lo``, ``hi``, half open) that overlap.

    An interval is dealt to the blocks of its group that it touches; a pair meets in the block where it starts
    to overlap, so it comes once. The block is as wide as the widest interval, which then touches two.
    """
    widths = intervals.groupBy(group).agg(F.greatest(F.max(F.col("hi") - F.col("lo")), F.lit(1e-9)).alias("_w"))
    i = intervals.where("lo < hi").join(widths, group)
    block = F.explode(F.sequence(F.floor(F.col("lo") / F.col("_w")), F.floor(F.col("hi") / F.col("_w"))))
    dealt = i.select(group, "id", "lo", "hi", "_w", block.alias("_b"))
    x, y = dealt.alias("x"), dealt.alias("y")
    same = [F.col(f"x.{group}") == F.col(f"y.{group}"), F.col("x._b") == F.col("y._b"), F.col("x.id") < F.col("y.id"), F.col("x.lo") < F.col("y.hi"), F.col("y.lo") < F.col("x.hi")]
    first = F.floor(F.greatest("x.lo", "y.lo") / F.col("x._w")) == F.col("x._b")
    return x.join(y, same).where(first).select(F.col(f"x.{group}").alias(group), F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def union_of_intervals(intervals: DataFrame, group: str) -> DataFrame:
    """A group's ``lo``, ``hi`` merged where they touch or overlap."""
    w = W.Window.partitionBy(group).orderBy("lo", "hi")
    i = intervals.withColumn("_m", F.max("hi").over(w.rowsBetween(W.Window.unboundedPreceding, -1)))
    i = i.withColumn("_run", F.sum((F.col("_m").isNull() | (F.col("lo") > F.col("_m"))).cast("int")).over(w))
    return i.groupBy(group, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def depths(intervals: DataFrame, group: str) -> DataFrame:
    """The stretches between a group's interval ends, each with how many intervals cover it: ``lo``, ``hi``, ``depth``."""
    ends = intervals.select(group, F.col("lo").alias("at"), F.lit(1).alias("d")).union(intervals.select(group, F.col("hi"), F.lit(-1)))
    steps = ends.groupBy(group, "at").agg(F.sum("d").alias("d"))
    w = W.Window.partitionBy(group).orderBy("at")
    out = steps.select(group, F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), F.sum("d").over(w).alias("depth"))
    return out.where("hi is not null")


def points_in_polygons(points: DataFrame, edges: DataFrame, width: float) -> DataFrame:
    """``id``, ``polygon`` where a point lies in it, by the parity of the edges to its right.

    ``edges``: ``polygon``, ``x1``, ``y1``, ``x2``, ``y2``. Points and edges meet by polygon-free bands of ``width`` in y.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    p = points.withColumn("band", F.floor(F.col("y") / width))
    crosses = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    right = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return p.join(e, "band").where(crosses & right).groupBy("id", "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", "polygon")


def crossings(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs of segments (``id``, ``x1``, ``y1``, ``x2``, ``y2``) that cross properly: ``id``, ``other``. They meet by grid cells of their boxes."""
    def dealt(s: DataFrame, p: str) -> DataFrame:
        box = lambda a, b: F.sequence(F.floor(F.least(a, b) / width), F.floor(F.greatest(a, b) / width))
        s = s.withColumn("cx", F.explode(box("x1", "x2"))).withColumn("cy", F.explode(box("y1", "y2")))
        return s.select("cx", "cy", *(F.col(c).alias(p + c) for c in ("id", "x1", "y1", "x2", "y2")))

    o = lambda a, b, c, d, e, f: geo.orientation(*(F.col(n) for n in (a, b, c, d, e, f)))
    apart = (o("ax1", "ay1", "ax2", "ay2", "bx1", "by1") * o("ax1", "ay1", "ax2", "ay2", "bx2", "by2") < 0) & (
        o("bx1", "by1", "bx2", "by2", "ax1", "ay1") * o("bx1", "by1", "bx2", "by2", "ax2", "ay2") < 0
    )
    return dealt(left, "a").join(dealt(right, "b"), ["cx", "cy"]).where(apart).select(F.col("aid").alias("id"), F.col("bid").alias("other")).distinct()
