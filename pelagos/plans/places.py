"""Queries on places, routes, intervals and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import geo
from pelagos.functions.num import half_up
from pelagos.operators import graph
from pelagos.operators import spatial as S
from pelagos.plans.base import haversine_sql, lat, lat_sql, lng, lng_sql, round_sql, table
from pelagos.sources.scratch import written

W_ = W.Window


def places(spark, sf, name, key):
    return table(spark, sf, name).select(F.col(key).cast("bigint").alias("id"), lat(key).alias("lat"), lng(key).alias("lng"))


def places_sql(name, key, alias):
    return f"{alias} AS (SELECT {key}::BIGINT AS id, {lat_sql(key)} AS lat, {lng_sql(key)} AS lng FROM {name})"


_PORTS, _STATIONS, _BAYS = places_sql("customer", "c_custkey", "p"), places_sql("supplier", "s_suppkey", "s"), places_sql("nation", "n_nationkey", "n")
_PS = f"{_PORTS}, {_STATIONS}, d AS (SELECT p.id, s.id AS other, {haversine_sql('p', 's')} AS km FROM p, s)"


def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a = places(spark, sf, "nation", "n_nationkey")
    b = a.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    d = geo.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"), geo.RADIUS_NM)
    return a.join(b, F.col("id") < F.col("other")).select("id", "other", half_up(d, 6).alias("nm"))


def _legs(spark, sf):
    w = W_.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", lat("s_suppkey").alias("lat"), lng("s_suppkey").alias("lng"))
    s = s.withColumns({"seq": F.row_number().over(w), "lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)})
    d = geo.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"), geo.RADIUS_NM)
    return s.where("lat2 is not null").withColumn("nm", d).withColumnRenamed("s_nationkey", "route")


_LEGS_SQL = f"""l0 AS (SELECT s_nationkey AS route, s_suppkey, {lat_sql('s_suppkey')} AS lat, {lng_sql('s_suppkey')} AS lng FROM supplier),
l1 AS (SELECT *, row_number() OVER w AS seq, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM l0 WINDOW w AS (PARTITION BY route ORDER BY s_suppkey)),
a AS (SELECT *, 1 AS one FROM l1 WHERE lat2 IS NOT NULL),
legs AS (SELECT a.*, 2 * 3440.065::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS nm FROM (SELECT *, power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng) / 2), 2) AS h FROM a) a)"""


def initial_bearing(spark, sf):
    b = geo.bearing(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    return _legs(spark, sf).select("s_suppkey", half_up(b, 6).alias("bearing"))


def cumulative_distance(spark, sf):
    w = W_.partitionBy("route").orderBy("seq").rowsBetween(W_.unboundedPreceding, 0)
    return _legs(spark, sf).select("route", F.col("seq").cast("bigint").alias("seq"), half_up(F.sum("nm").over(w), 6).alias("nm"))


def nearest_station(spark, sf):
    """Each port's nearest station within 200 km."""
    n = S.nearest(places(spark, sf, "customer", "c_custkey"), places(spark, sf, "supplier", "s_suppkey"), 200.0)
    return n.select("id", "other", half_up(F.col("km"), 6).alias("km"))


def radius_join(spark, sf):
    r = S.radius_join(places(spark, sf, "customer", "c_custkey"), places(spark, sf, "supplier", "s_suppkey"), 60.0)
    return r.select("id", "other", half_up(F.col("km"), 1).alias("km"))


def topk_nearest(spark, sf):
    r = S.radius_join(places(spark, sf, "nation", "n_nationkey"), places(spark, sf, "customer", "c_custkey"), 300.0)
    w = W_.partitionBy("id").orderBy("km", "other")
    return r.withColumn("k", F.row_number().over(w)).where("k <= 50").select("id", "other", F.col("k").cast("bigint").alias("k"))


def nearest_with_margin(spark, sf):
    r = S.nearest_two(places(spark, sf, "customer", "c_custkey"), places(spark, sf, "supplier", "s_suppkey"), 200.0)
    return r.select("id", "other", F.when(F.col("second").isNull(), "alone").when(F.col("km") * 1.5 <= F.col("second"), "clear").otherwise("tied").alias("state"))


def voronoi_assign(spark, sf):
    """Grid cells given to the nearest site within 80 km."""
    grid = spark.range(40 * 40).select(F.col("id"), (F.lit(-40.0) + F.floor(F.col("id") / 40) * 0.25).alias("lat"), (F.lit(-76.0) + (F.col("id") % 40) * 0.25).alias("lng"))
    n = S.nearest(grid, places(spark, sf, "supplier", "s_suppkey"), 80.0)
    return n.select("id", "other")


def nn_distance_stats(spark, sf):
    p = places(spark, sf, "supplier", "s_suppkey")
    d = S.radius_join(p, p, 600.0).where("id <> other").groupBy("id").agg(F.min("km").alias("km"))
    return d.agg(half_up(F.min("km"), 6).alias("least"), half_up(F.median("km"), 6).alias("middle"), F.count("*").alias("n"))


def expanding_radius_nn(spark, sf):
    """Radii double until a station is found, and the answer holds only within half of the radius tried; ports without one have none."""
    found, left = None, places(spark, sf, "customer", "c_custkey")
    stations = places(spark, sf, "supplier", "s_suppkey")
    for km in (50.0, 100.0, 200.0, 400.0):
        hit = written(S.within(left, stations, km / 2).withColumn("tried", F.lit(km)), "nearest")
        left = left.join(hit, "id", "left_anti")
        found = hit if found is None else found.union(hit)
    none = left.select("id", F.lit(None).cast("bigint"), F.lit(None).cast("double"))
    return found.select("id", "other", "tried").union(none)


def anchorage_before(spark, sf):
    """Stations within 30 km of a bay and over 80 km from every restricted one."""
    s, bays = places(spark, sf, "supplier", "s_suppkey"), places(spark, sf, "customer", "c_custkey")
    near = S.radius_join(s, bays.where("id % 10 <> 0"), 30.0).where("km < 30").select("id").distinct()
    closed = S.radius_join(s, bays.where("id % 50 = 0"), 80.0).select("id").distinct()
    return near.join(closed, "id", "left_anti")


def _spans(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("id"), (F.col("l_linenumber") * 10.0).alias("lo"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias("hi"))


_SPANS_SQL = "i AS (SELECT l_orderkey, l_linenumber::BIGINT AS id, l_linenumber * 10.0::DOUBLE AS lo, l_linenumber * 10.0::DOUBLE + l_quantity AS hi FROM lineitem)"


def overlap_pairs(spark, sf):
    return S.overlapping(_spans(spark, sf), "l_orderkey")


def pairs_not_permitted(spark, sf):
    """Overlaps but for those of a list, whichever way round it names a pair."""
    pairs = S.overlapping(_spans(spark, sf), "l_orderkey")
    allowed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.greatest("l_linenumber", F.lit(2)).alias("x"), F.least("l_linenumber", F.lit(2)).alias("y"))
    allowed = allowed.select("l_orderkey", F.least("x", "y").cast("bigint").alias("a"), F.greatest("x", "y").cast("bigint").alias("b")).distinct()
    return pairs.join(allowed, ["l_orderkey", "a", "b"], "left_anti")


def interval_union(spark, sf):
    return S.union_of_intervals(_spans(spark, sf), "l_orderkey")


def coverage_depth(spark, sf):
    """Length of each order's span that none, one or more of its intervals cover."""
    d = S.depths(_spans(spark, sf), "l_orderkey")
    kind = F.when(F.col("depth") == 0, "gap").when(F.col("depth") == 1, "single").otherwise("overlap")
    return d.groupBy("l_orderkey", kind.alias("kind")).agg(F.sum(F.col("hi") - F.col("lo")).alias("length"))


def uncovered_intervals(spark, sf):
    return S.depths(_spans(spark, sf), "l_orderkey").where("depth = 0").select("l_orderkey", "lo", "hi")


def extent_agg(spark, sf):
    p = table(spark, sf, "customer").select("c_nationkey", lat("c_custkey").alias("y"), lng("c_custkey").alias("x"))
    return p.groupBy("c_nationkey").agg(*(half_up(f(c), 6).alias(n) for n, f, c in (("x1", F.min, "x"), ("x2", F.max, "x"), ("y1", F.min, "y"), ("y2", F.max, "y"))))


def _boxes(spark, sf):
    """A diamond around each nation's place: its four edges."""
    n = places(spark, sf, "nation", "n_nationkey")
    c = [("lng", -1.5, "lat", 0.0), ("lng", 0.0, "lat", 2.0), ("lng", 1.5, "lat", 0.0), ("lng", 0.0, "lat", -2.0)]
    edge = lambda a, b: F.struct((F.col("lng") + c[a][1]).alias("x1"), (F.col("lat") + c[a][3]).alias("y1"), (F.col("lng") + c[b][1]).alias("x2"), (F.col("lat") + c[b][3]).alias("y2"))
    return n.select(F.col("id").alias("polygon"), F.explode(F.array(edge(0, 1), edge(1, 2), edge(2, 3), edge(3, 0))).alias("e")).select("polygon", "e.*")


def point_in_polygon(spark, sf):
    p = places(spark, sf, "customer", "c_custkey").select("id", (F.col("lng") + 0.0037).alias("x"), (F.col("lat") + 0.0023).alias("y"))
    return S.points_in_polygons(p, _boxes(spark, sf), 0.5)


def segment_crossings(spark, sf):
    """Route legs that cross the polygons' edges, by polygon."""
    legs = _legs(spark, sf).select(F.col("s_suppkey").alias("id"), (F.col("lng") + 0.0037).alias("x1"), (F.col("lat") + 0.0023).alias("y1"), (F.col("lng2") + 0.0041).alias("x2"), (F.col("lat2") + 0.0029).alias("y2"))
    edges = _boxes(spark, sf).withColumn("id", F.col("polygon") * 10 + F.when(F.col("x1") < F.col("x2"), 1).otherwise(0) + F.when(F.col("y1") < F.col("y2"), 2).otherwise(0))
    return S.crossings(legs, edges, 1.0)


_BOX_SQL = f"""{_BAYS}, c AS (SELECT id AS polygon, lng, lat FROM n),
e AS (SELECT polygon, lng + a AS x1, lat + b AS y1, lng + c AS x2, lat + d AS y2 FROM c, (VALUES (-1.5::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE), (0.0::DOUBLE, 2.0::DOUBLE, 1.5::DOUBLE, 0.0::DOUBLE), (1.5::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, -2.0::DOUBLE), (0.0::DOUBLE, -2.0::DOUBLE, -1.5::DOUBLE, 0.0::DOUBLE)) v(a, b, c, d))"""


def point_segment_distance(spark, sf):
    legs = _legs(spark, sf)
    d = geo.segment_distance(F.lit(-71.0), F.lit(-35.0), F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"))
    return legs.select("s_suppkey", half_up(d, 6).alias("d"))


def decimate_path(spark, sf):
    """Every third point of a path, its first and its last."""
    w = W_.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf, "supplier").withColumns({"k": F.row_number().over(w) - 1, "n": F.count("*").over(W_.partitionBy("s_nationkey"))})
    return s.where("k % 3 = 0 or k = n - 1").select("s_nationkey", "s_suppkey")


def subdivide_leg(spark, sf):
    """Way-points put into long legs: as many parts as 150-mile pieces or two-degree steps ask for."""
    legs = _legs(spark, sf)
    n = F.greatest(F.ceil(F.col("nm") / 150), F.ceil(F.abs(F.col("lat2") - F.col("lat")) / 2)).cast("int")
    cut = legs.withColumn("n", n).where("n > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    return cut.select("s_suppkey", F.col("i").cast("bigint").alias("i"), half_up(F.col("lat") + (F.col("lat2") - F.col("lat")) * F.col("i") / F.col("n"), 6).alias("lat"))


def _grid(spark, sf):
    li = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 64).alias("r"), (F.col("l_partkey") % 64).alias("c")).agg((F.max("l_quantity") * 100).cast("bigint").alias("v"))
    return li


_GRID_SQL = "g AS (SELECT l_orderkey % 64 AS r, l_partkey % 64 AS c, CAST(max(l_quantity) * 100 AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


def max_pool(spark, sf):
    g = _grid(spark, sf)
    return g.groupBy(F.floor(F.col("r") / 8).alias("r"), F.floor(F.col("c") / 8).alias("c")).agg(F.max("v").alias("v"))


def decimate_grid(spark, sf):
    return _grid(spark, sf).where("r % 4 = 0 and c % 4 = 0")


def pack_unpack(spark, sf):
    """Fifteenth bit: relaxed; two bits: confidence; thirteen: distance in steps of ten metres."""
    g = _grid(spark, sf)
    packed = F.shiftleft(F.col("r") % 2, 15).bitwiseOR(F.shiftleft(F.col("c") % 4, 13)).bitwiseOR(F.least(F.col("v"), F.lit(8191)))
    g = g.select("r", "c", packed.alias("packed"))
    return g.select("r", "c", "packed", F.shiftright("packed", 15).bitwiseAND(1).alias("relaxed"), F.shiftright("packed", 13).bitwiseAND(3).alias("confidence"), (F.col("packed").bitwiseAND(8191) * 10).alias("metres"))


def dilate_cells(spark, sf):
    g = _grid(spark, sf).where("v >= 4990").select("r", "c")
    span = F.sequence(F.lit(-2), F.lit(2))
    d = g.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    return d.where("r between 0 and 63 and c between 0 and 63").distinct()


def local_width(spark, sf):
    """How far the next blocked cell of a row lies on either side."""
    g = _grid(spark, sf).withColumn("b", F.when(F.col("v") >= 4950, F.col("c")))
    w = W_.partitionBy("r").orderBy("c")
    left = F.last("b", True).over(w.rowsBetween(W_.unboundedPreceding, -1))
    right = F.first("b", True).over(w.rowsBetween(1, W_.unboundedFollowing))
    return g.withColumns({"left": left, "right": right}).where("b is null and left is not null and right is not null").select("r", "c", (F.col("right") - F.col("left") - 1).alias("width"))


# Limits of the coastal bands in miles, and their cost factors.
_BANDS = ((5, 1.0), (10, 3.0), (20, 8.0), (40, 15.0))


def piecewise_cost(spark, sf):
    """The cost of each cell by its distance from the coast in metres: linear between the bands, constant beyond."""
    d = F.col("d")
    cost = F.when(d <= _BANDS[0][0] * 1852.0, _BANDS[0][1])
    for (a, fa), (b, fb) in zip(_BANDS, _BANDS[1:], strict=False):
        cost = cost.when(d <= b * 1852.0, fa + (fb - fa) * (d - a * 1852.0) / (b * 1852.0 - a * 1852.0))
    far = (F.col("v") - 4000) * 100.0
    return _grid(spark, sf).select("r", "c", F.greatest(far, F.lit(0.0)).alias("d")).select("r", "c", half_up(cost.otherwise(20.0), 6).alias("cost"))


def reachability(spark, sf):
    """Cells that four-neighbour steps reach from the grid's corner over cells under a limit: those of its component."""
    g = _grid(spark, sf).where("v <= 4980").select("r", "c", (F.col("r") * 64 + F.col("c")).alias("id"))
    step = lambda dr, dc: g.select("id", (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"))
    links = step(0, 1).union(step(1, 0)).join(g.withColumnRenamed("id", "b"), ["r", "c"]).select(F.col("id").alias("a"), "b")
    found = written(graph.components(links.union(g.select("id", F.col("id").alias("b")))), "components")
    home = found.where("node = 65").select("root")
    return found.join(home, "root").select(F.floor(F.col("node") / 64).alias("r"), (F.col("node") % 64).alias("c"))


_NM = haversine_sql("a", "b", 3440.065)
QUERIES = {
    "haversine_pairs": (haversine_pairs, f"WITH {_BAYS} SELECT a.id, b.id AS other, {round_sql(_NM, 6)} AS nm FROM n a JOIN n b ON a.id < b.id"),
    "initial_bearing": (initial_bearing, f"WITH {_LEGS_SQL}, t AS (SELECT s_suppkey, degrees(atan2(sin(radians(lng2 - lng)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lng2 - lng)))) + 360 AS b FROM legs) SELECT s_suppkey, {round_sql('CASE WHEN b >= 360 THEN b - 360 ELSE b END', 6)} AS bearing FROM t"),
    "cumulative_distance": (cumulative_distance, f"WITH {_LEGS_SQL} SELECT route, seq, {round_sql('sum(nm) OVER (PARTITION BY route ORDER BY seq)', 6)} AS nm FROM legs"),
    "nearest_station": (nearest_station, f"WITH {_PS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, other) AS k FROM d WHERE km <= 200) SELECT id, other, {round_sql('km', 6)} AS km FROM k WHERE k = 1"),
    "radius_join": (radius_join, f"WITH {_PS} SELECT id, other, {round_sql('km', 1)} AS km FROM d WHERE km <= 60"),
    "topk_nearest": (topk_nearest, f"WITH {_BAYS}, {_PORTS}, d AS (SELECT n.id, p.id AS other, {haversine_sql('n', 'p')} AS km FROM n, p), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, other) AS k FROM d WHERE km <= 300) SELECT id, other, k FROM k WHERE k <= 50"),
    "nearest_with_margin": (nearest_with_margin, f"WITH {_PS}, k AS (SELECT *, row_number() OVER w AS k, lead(km) OVER w AS second FROM d WHERE km <= 200 WINDOW w AS (PARTITION BY id ORDER BY km, other)) SELECT id, other, CASE WHEN second IS NULL THEN 'alone' WHEN km * 1.5::DOUBLE <= second THEN 'clear' ELSE 'tied' END AS state FROM k WHERE k = 1"),
    "voronoi_assign": (voronoi_assign, f"WITH g AS (SELECT i AS id, -40.0::DOUBLE + (i // 40) * 0.25::DOUBLE AS lat, -76.0::DOUBLE + (i % 40) * 0.25::DOUBLE AS lng FROM range(1600) t(i)), {_STATIONS}, d AS (SELECT g.id, s.id AS other, {haversine_sql('g', 's')} AS km FROM g, s) SELECT id, other FROM d WHERE km <= 80 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, other) = 1"),
    "nn_distance_stats": (nn_distance_stats, f"WITH {_STATIONS}, d AS (SELECT a.id, min({haversine_sql('a', 'b')}) AS km FROM s a, s b WHERE a.id <> b.id GROUP BY a.id) SELECT {round_sql('min(km)', 6)} AS least, {round_sql('median(km)', 6)} AS middle, count(*) AS n FROM d WHERE km <= 600"),
    "expanding_radius_nn": (expanding_radius_nn, f"WITH {_PS}, k AS (SELECT id, arg_min(other, (km, other)) AS other, min(km) AS km FROM d GROUP BY id) SELECT id, CASE WHEN km <= 200 THEN other END AS other, CASE WHEN km <= 25 THEN 50.0::DOUBLE WHEN km <= 50 THEN 100.0::DOUBLE WHEN km <= 100 THEN 200.0::DOUBLE WHEN km <= 200 THEN 400.0::DOUBLE END AS tried FROM k"),
    "anchorage_before": (anchorage_before, f"WITH {_PS} SELECT DISTINCT other AS id FROM d WHERE id % 10 <> 0 AND km < 30 AND other NOT IN (SELECT other FROM d WHERE id % 50 = 0 AND km <= 80)"),
    "overlap_pairs": (overlap_pairs, f"WITH {_SPANS_SQL} SELECT x.l_orderkey, x.id AS a, y.id AS b FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.id < y.id AND x.lo < y.hi AND y.lo < x.hi WHERE x.lo < x.hi AND y.lo < y.hi"),
    "pairs_not_permitted": (pairs_not_permitted, f"WITH {_SPANS_SQL} SELECT x.l_orderkey, x.id AS a, y.id AS b FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.id < y.id AND x.lo < y.hi AND y.lo < x.hi WHERE NOT EXISTS (SELECT 1 FROM lineitem z WHERE z.l_returnflag = 'R' AND z.l_orderkey = x.l_orderkey AND least(z.l_linenumber, 2) = x.id AND greatest(z.l_linenumber, 2) = y.id)"),
    "interval_union": (interval_union, f"WITH {_SPANS_SQL}, m AS (SELECT *, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), r AS (SELECT *, sum(CASE WHEN m IS NULL OR lo > m THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY lo, hi) AS run FROM m) SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY l_orderkey, run"),
    "coverage_depth": (coverage_depth, f"WITH {_SPANS_SQL}, t AS (SELECT l_orderkey, lo AS e FROM i UNION SELECT l_orderkey, hi FROM i), p AS (SELECT l_orderkey, e AS lo, lead(e) OVER (PARTITION BY l_orderkey ORDER BY e) AS hi FROM t), c AS (SELECT p.l_orderkey, p.lo, p.hi, count(i.id) AS depth FROM p LEFT JOIN i ON i.l_orderkey = p.l_orderkey AND i.lo <= p.lo AND i.hi >= p.hi WHERE p.hi IS NOT NULL GROUP BY ALL) SELECT l_orderkey, CASE depth WHEN 0 THEN 'gap' WHEN 1 THEN 'single' ELSE 'overlap' END AS kind, sum(hi - lo) AS length FROM c GROUP BY ALL"),
    "uncovered_intervals": (uncovered_intervals, f"WITH {_SPANS_SQL}, m AS (SELECT l_orderkey, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi) AS lo, lead(lo) OVER (PARTITION BY l_orderkey ORDER BY lo, hi) AS hi FROM i) SELECT l_orderkey, lo, hi FROM m WHERE lo < hi"),
    "extent_agg": (extent_agg, f"WITH p AS (SELECT c_nationkey, {lat_sql('c_custkey')} AS y, {lng_sql('c_custkey')} AS x FROM customer) SELECT c_nationkey, {round_sql('min(x)', 6)} AS x1, {round_sql('max(x)', 6)} AS x2, {round_sql('min(y)', 6)} AS y1, {round_sql('max(y)', 6)} AS y2 FROM p GROUP BY 1"),
    "point_in_polygon": (point_in_polygon, f"WITH {_BOX_SQL}, {_PORTS} SELECT p.id, c.polygon FROM p, c WHERE abs(p.lng + 0.0037 - c.lng) / 1.5 + abs(p.lat + 0.0023 - c.lat) / 2 < 1"),
    "segment_crossings": (segment_crossings, f"""WITH {_BOX_SQL}, {_LEGS_SQL}, l AS (SELECT s_suppkey AS id, lng + 0.0037::DOUBLE AS a_x, lat + 0.0023::DOUBLE AS a_y, lng2 + 0.0041::DOUBLE AS b_x, lat2 + 0.0029::DOUBLE AS b_y FROM legs),
      k AS (SELECT polygon * 10 + CASE WHEN x1 < x2 THEN 1 ELSE 0 END + CASE WHEN y1 < y2 THEN 2 ELSE 0 END AS other, * FROM e)
      SELECT DISTINCT l.id, k.other FROM l, k WHERE sign((b_x - a_x) * (y1 - a_y) - (b_y - a_y) * (x1 - a_x)) * sign((b_x - a_x) * (y2 - a_y) - (b_y - a_y) * (x2 - a_x)) < 0 AND sign((x2 - x1) * (a_y - y1) - (y2 - y1) * (a_x - x1)) * sign((x2 - x1) * (b_y - y1) - (y2 - y1) * (b_x - x1)) < 0"""),
    "point_segment_distance": (point_segment_distance, f"WITH {_LEGS_SQL}, v AS (SELECT s_suppkey, lng AS ax, lat AS ay, lng2 - lng AS dx, lat2 - lat AS dy FROM legs), t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((-71 - ax) * dx + (-35 - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM v) SELECT s_suppkey, {round_sql('sqrt(power(-71 - ax - t * dx, 2) + power(-35 - ay - t * dy, 2))', 6)} AS d FROM t"),
    "decimate_path": (decimate_path, "WITH k AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey FROM k WHERE k % 3 = 0 OR k = n - 1"),
    "subdivide_leg": (subdivide_leg, f"WITH {_LEGS_SQL}, n AS (SELECT *, greatest(ceil(nm / 150), ceil(abs(lat2 - lat) / 2))::INT AS n FROM legs), i AS (SELECT *, unnest(range(1, n)) AS i FROM n WHERE n > 1) SELECT s_suppkey, i, {round_sql('lat + (lat2 - lat) * i / n', 6)} AS lat FROM i"),
    "max_pool": (max_pool, f"WITH {_GRID_SQL} SELECT r // 8 AS r, c // 8 AS c, max(v) AS v FROM g GROUP BY 1, 2"),
    "decimate_grid": (decimate_grid, f"WITH {_GRID_SQL} SELECT * FROM g WHERE r % 4 = 0 AND c % 4 = 0"),
    "pack_unpack": (pack_unpack, f"WITH {_GRID_SQL} SELECT r, c, (r % 2) * 32768 + (c % 4) * 8192 + least(v, 8191) AS packed, r % 2 AS relaxed, c % 4 AS confidence, least(v, 8191) * 10 AS metres FROM g"),
    "dilate_cells": (dilate_cells, f"WITH {_GRID_SQL}, s AS (SELECT r, c FROM g WHERE v >= 4990) SELECT x.i AS r, y.i AS c FROM range(64) x(i), range(64) y(i) WHERE EXISTS (SELECT 1 FROM s WHERE abs(s.r - x.i) <= 2 AND abs(s.c - y.i) <= 2)"),
    "local_width": (local_width, f"WITH {_GRID_SQL}, b AS (SELECT r, c FROM g WHERE v >= 4950), w AS (SELECT g.r, g.c, (SELECT max(b.c) FROM b WHERE b.r = g.r AND b.c < g.c) AS l, (SELECT min(b.c) FROM b WHERE b.r = g.r AND b.c > g.c) AS h FROM g WHERE v < 4950) SELECT r, c, h - l - 1 AS width FROM w WHERE l IS NOT NULL AND h IS NOT NULL"),
    "piecewise_cost": (piecewise_cost, f"WITH {_GRID_SQL}, d AS (SELECT r, c, greatest((v - 4000) * 100.0::DOUBLE, 0) / 1852 AS m FROM g) SELECT r, c, {round_sql('CASE WHEN m <= 5 THEN 1.0::DOUBLE WHEN m <= 10 THEN 1 + 2 * (m - 5) / 5 WHEN m <= 20 THEN 3 + 5 * (m - 10) / 10 WHEN m <= 40 THEN 8 + 7 * (m - 20) / 20 ELSE 20 END', 6)} AS cost FROM d"),
    "reachability": (reachability, f"WITH RECURSIVE {_GRID_SQL}, w AS (SELECT r, c FROM g WHERE v <= 4980), f(r, c) AS (SELECT r, c FROM w WHERE r = 1 AND c = 1 UNION SELECT w.r, w.c FROM f JOIN w ON abs(w.r - f.r) + abs(w.c - f.c) = 1) SELECT r, c FROM f"),
}
