"""Queries on cells: filled polygons, masks, borders, straightened paths, searches in a corridor, waters, zones, binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.functions.num import half_up
from pelagos.operators import portals, raster, waters
from pelagos.plans.base import lat, lat_sql, lng, lng_sql, round_sql, table
from pelagos.plans.places import _GRID_SQL, _PORTS, _grid, places
from pelagos.sources import published as P
from pelagos.sources import tiles
from pelagos.sources.scratch import path

_CELL, _BAND = 0.05, 0.12
#: Corners of the area around a place, in turn.
_CORNERS = ((-0.31, 0.02), (0.03, 0.42), (0.33, -0.01), (-0.04, -0.43))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), lat("s_suppkey").alias("y"), lng("s_suppkey").alias("x"))
    turns = zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True)
    sides = F.array(*(F.struct((F.col("x") + a).alias("x1"), (F.col("y") + b).alias("y1"), (F.col("x") + c).alias("x2"), (F.col("y") + d).alias("y2")) for (a, b), (c, d) in turns))
    return s.select("id", F.explode(sides).alias("e")).select("id", "e.*")


_VALUES = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True))
_EDGES_SQL = f"s AS (SELECT s_suppkey::BIGINT AS id, {lat_sql('s_suppkey')} AS y, {lng_sql('s_suppkey')} AS x FROM supplier), e AS (SELECT id, x + a AS x1, y + b AS y1, x + c AS x2, y + d AS y2 FROM s, (VALUES {_VALUES}) v(a, b, c, d))"
_BOX_SQL = f"""b AS (SELECT id, floor((min(least(x1, x2)) - 0.2) / {_CELL}::DOUBLE)::BIGINT AS c1, floor((max(greatest(x1, x2)) + 0.2) / {_CELL}::DOUBLE)::BIGINT AS c2, floor((min(least(y1, y2)) - 0.2) / {_CELL}::DOUBLE)::BIGINT AS r1, floor((max(greatest(y1, y2)) + 0.2) / {_CELL}::DOUBLE)::BIGINT AS r2 FROM e GROUP BY id),
  k AS (SELECT id, r, unnest(range(c1, c2 + 1)) AS c FROM (SELECT *, unnest(range(r1, r2 + 1)) AS r FROM b)),
  m AS (SELECT id, r, c, (c + 0.5::DOUBLE) * {_CELL}::DOUBLE AS px, (r + 0.5::DOUBLE) * {_CELL}::DOUBLE AS py FROM k)"""
_FILL_SQL = f"""{_EDGES_SQL}, {_BOX_SQL}, inside AS (SELECT m.id, m.r, m.c FROM m JOIN e ON m.id = e.id AND py >= least(y1, y2) AND py < greatest(y1, y2) WHERE x1 + (py - y1) * (x2 - x1) / (y2 - y1) <= px GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""
_BAND_SQL = f"""t AS (SELECT m.*, e.x1, e.y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM m JOIN e USING (id)),
  band AS (SELECT DISTINCT id, r, c FROM t WHERE sqrt(power(px - x1 - t * dx, 2) + power(py - y1 - t * dy, 2)) <= {_BAND}::DOUBLE)"""


def rasterise_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """The cells within each supplier's area."""
    return raster.fill(_edges(spark, sf), _CELL)


def raster_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of any area that are not near any outline."""
    return raster.mask(_edges(spark, sf), _BAND, _CELL)


def border_gap_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Cells in no, one or several areas, along each area's outline."""
    return raster.border_cells(_edges(spark, sf), _BAND, _CELL)


def _path(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    walk = lambda n: F.abs(F.floor(k / n) % 126 - 63)
    return table(spark, sf, "customer").select(F.floor((k - 1) / 64).alias("route"), ((k - 1) % 64).alias("seq"), walk(8).alias("r"), walk(5).alias("c"))


def string_pull(spark: SparkSession, sf: str) -> DataFrame:
    """The points that paths keep when they are pulled straight over free cells of the grid."""
    walls = _grid(spark, sf).where("v >= 4995 and (7 * r + 3 * c) % 9 = 0")
    return raster.string_pull(_path(spark, sf), walls)


def corridor_route(spark: SparkSession, sf: str) -> DataFrame:
    """The cost of a way across the grid, looked for along the best way over blocks of eight by eight cells."""
    at = lambda r, c: spark.range(1).select(F.lit(r).cast("bigint").alias("r"), F.lit(c).cast("bigint").alias("c"))
    g = _grid(spark, sf).select("r", "c", F.col("v").alias("w"))
    return raster.corridor_cost(g, at(10, 10), at(55, 40), 8, 2, 32).select("cost", "via")


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 64).alias("r"), (F.col("l_partkey") % 64).alias("c")).agg(F.min("l_quantity").cast("bigint").alias("w"))


def portal_routes(spark: SparkSession, sf: str) -> DataFrame:
    """What ways across the grid cost, one for each nation, from portal to portal of tiles of sixteen by sixteen cells."""
    k = F.col("n_nationkey").cast("bigint")
    asked = table(spark, sf, "nation").select(k.alias("id"), (k * 7 % 64).alias("r0"), (k * 11 % 64).alias("c0"), (63 - k * 5 % 64).alias("r1"), (63 - k * 13 % 64).alias("c1"))
    cells = _prices(spark, sf)
    return portals.portal_costs(cells, portals.portal_ways(cells, 16), asked, 16)


def bounded_water_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The water beside each supplier's crossing, counted up to 40 cells within 8 cells of it; the crossing itself is not entered."""
    water = _grid(spark, sf).where("(v + 3 * r + 5 * c) % 9 < 4").select("r", "c")
    k = F.col("s_suppkey").cast("bigint")
    anchors = table(spark, sf, "supplier").select(k.alias("id"), (k * 7 % 64).alias("r"), (k * 11 % 64).alias("c"))
    own = anchors.select("id", F.explode(F.array("r", F.col("r") + 1)).alias("r"), (F.col("c") + 1).alias("c"))
    seeds = waters.seeds_near(anchors, water, 2, own).join(anchors.select("id", F.col("r").alias("r0"), F.col("c").alias("c0")), "id")
    return waters.bounded_waters(water, seeds, 8, 40, own)


def least_width(spark: SparkSession, sf: str) -> DataFrame:
    """How narrow the water of the grid is at each of its cells, on four axes, up to ten steps a side."""
    return waters.least_widths(_grid(spark, sf).where("(v + 3 * r + 5 * c) % 9 < 6"), 10)


#: Lines of zones: from one turn to the next.
_TURNS = ((0.0, 0.0), (0.7, 0.4), (0.9, -0.6))


def zones_reaching(spark: SparkSession, sf: str) -> DataFrame:
    """The zones (points and lines with buffers, one for each nation) that reach a port, the nearest first."""
    n = places(spark, sf, "nation", "n_nationkey")
    line = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip("abcd", (*p, *q), strict=True))) for p, q in zip(_TURNS, _TURNS[1:], strict=False)))
    point = F.array(F.struct(*(F.lit(0.0).alias(k) for k in "abcd")))
    parts = n.select(F.col("id").alias("zone"), "lng", "lat", F.explode(F.when(F.col("id") % 2 == 0, point).otherwise(line)).alias("s"))
    zones = parts.select("zone", *((F.col(at) + F.col(f"s.{k}")).alias(name) for at, k, name in (("lng", "a", "x1"), ("lat", "b", "y1"), ("lng", "c", "x2"), ("lat", "d", "y2"))), (F.col("zone") % 5 * 0.1 + 0.35).alias("buffer"))
    ports = places(spark, sf, "customer", "c_custkey").select("id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return waters.zones_reaching(ports, zones, 0.2).select("id", "zone", "place", half_up(F.col("distance"), 6).alias("distance"))


def raster_files(spark: SparkSession, sf: str) -> DataFrame:
    """The grid and its coarse level written as binary bands of rows and read back by ranges of rows."""
    g = _grid(spark, sf)
    coarse = g.groupBy(F.floor(F.col("r") / 8).alias("r"), F.floor(F.col("c") / 8).alias("c")).agg(F.max("v").alias("v"))
    both = g.select(F.lit("grid").alias("tile"), "r", "c", "v").union(coarse.select(F.lit("grid.coarse").alias("tile"), "r", "c", "v"))
    to = path(spark, "tiles")
    tiles.write_tiles(both, to, {"grid": {"rows": 64, "cols": 64, "coarse_factor": 8}, "grid.coarse": {"rows": 8, "cols": 8}}, 16)
    return tiles.read_tiles(spark, to, 4)


def coast_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Controls on the areas' outlines as written by cells of two degrees: what was read, covered, shared, fine enough and inside."""
    edges = _edges(spark, sf)
    centres = places(spark, sf, "supplier", "s_suppkey").select("id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    controls = {
        "A4": P.as_read(edges.count(), ["id", "x1", "y1", "x2", "y2"]), "A4b": P.covers(centres), "A5": P.overlaps_as_declared(False, _CELL),
        "A6": P.denser(table(spark, sf, "nation").count(), 10), "A7": P.holds(centres, 0.5),
    }
    return P.publish(edges, path(spark, "coast"), F.col("x1"), F.col("y1"), 2.0, controls, 16)


def published_box(spark: SparkSession, sf: str) -> DataFrame:
    """Sides of areas that begin within a box, from the folders of its cells of the published version."""
    edges, to = _edges(spark, sf), path(spark, "coast")
    P.publish(edges, to, F.col("x1"), F.col("y1"), 2.0, {"A4": P.as_read(edges.count(), ["id", "x1", "y1"])}, 16)
    return P.published(spark, to, (-74.0, -40.0, -70.0, -30.0), 2.0).where("x1 between -74 and -70 and y1 between -40 and -30")


QUERIES = {
    "rasterise_polygons": (rasterise_polygons, f"WITH {_FILL_SQL} SELECT * FROM inside"),
    "raster_mask": (raster_mask, f"WITH {_FILL_SQL}, {_BAND_SQL} SELECT DISTINCT r, c FROM inside WHERE (r, c) NOT IN (SELECT (r, c) FROM band)"),
    "border_gap_overlap": (border_gap_overlap, f"WITH {_FILL_SQL}, {_BAND_SQL}, h AS (SELECT r, c, count(*) AS n FROM inside GROUP BY 1, 2) SELECT id, count(*) FILTER (WHERE n IS NULL) AS gap, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n > 1) AS overlap FROM band LEFT JOIN h USING (r, c) GROUP BY id"),
    "string_pull": (string_pull, f"""WITH RECURSIVE {_GRID_SQL}, w AS (SELECT r, c FROM g WHERE v >= 4995 AND (7 * r + 3 * c) % 9 = 0),
      p AS (SELECT (c_custkey - 1) // 64 AS route, (c_custkey - 1) % 64 AS seq, abs(c_custkey // 8 % 126 - 63) AS r, abs(c_custkey // 5 % 126 - 63) AS c FROM customer),
      l AS (SELECT a.route, a.seq, b.seq AS k, a.r AS r0, a.c AS c0, b.r AS r1, b.c AS c1, greatest(1, abs(b.r - a.r), abs(b.c - a.c)) AS n FROM p a JOIN p b ON a.route = b.route AND b.seq > a.seq + 1),
      x AS (SELECT *, unnest(range(0, n + 1)) AS s FROM l),
      h AS (SELECT route, seq, min(k) AS hit FROM x JOIN w ON w.r = floor(r0 + (r1 - r0) * (s::DOUBLE / n) + 0.5::DOUBLE) AND w.c = floor(c0 + (c1 - c0) * (s::DOUBLE / n) + 0.5::DOUBLE) GROUP BY 1, 2),
      j AS (SELECT p.route, p.seq, coalesce(hit - 1, max(p.seq) OVER (PARTITION BY p.route)) AS far FROM p LEFT JOIN h USING (route, seq)),
      f(route, seq) AS (SELECT route, seq FROM p WHERE seq = 0 UNION SELECT j.route, j.far FROM f JOIN j USING (route, seq)) SELECT route, seq FROM f"""),
    "corridor_route": (corridor_route, f"""WITH RECURSIVE {_GRID_SQL}, o AS (SELECT i.i, j.i AS j FROM range(-1, 2) i(i), range(-1, 2) j(i) WHERE i.i <> 0 OR j.i <> 0),
      f(r, c, cost) USING KEY (r, c) AS (SELECT r, c, 0::BIGINT FROM g WHERE r = 10 AND c = 10 UNION
        SELECT r, c, n.cost FROM (SELECT g.r, g.c, min(f.cost + g.v)::BIGINT AS cost FROM f, o, g WHERE g.r = f.r + o.i AND g.c = f.c + o.j GROUP BY 1, 2) n LEFT JOIN recurring.f k USING (r, c) WHERE k.cost IS NULL OR n.cost < k.cost)
      SELECT cost, 'corridor' AS via FROM f WHERE r = 55 AND c = 40"""),
    "portal_routes": (portal_routes, """WITH RECURSIVE g AS (SELECT l_orderkey % 64 AS r, l_partkey % 64 AS c, min(l_quantity)::BIGINT AS w FROM lineitem GROUP BY 1, 2),
      q AS (SELECT n_nationkey::BIGINT AS id, n_nationkey * 7 % 64 AS r0, n_nationkey * 11 % 64 AS c0, 63 - n_nationkey * 5 % 64 AS r1, 63 - n_nationkey * 13 % 64 AS c1 FROM nation),
      o AS (SELECT i.i, j.i AS j FROM range(-1, 2) i(i), range(-1, 2) j(i) WHERE i.i <> 0 OR j.i <> 0),
      f(id, r, c, cost) USING KEY (id, r, c) AS (SELECT id, g.r, g.c, 0::BIGINT FROM q JOIN g ON g.r = r0 AND g.c = c0 UNION
        SELECT id, r, c, n.cost FROM (SELECT f.id, g.r, g.c, min(f.cost + g.w)::BIGINT AS cost FROM f, o, g WHERE g.r = f.r + o.i AND g.c = f.c + o.j GROUP BY 1, 2, 3) n LEFT JOIN recurring.f k USING (id, r, c) WHERE k.cost IS NULL OR n.cost < k.cost)
      SELECT q.id, cost FROM q JOIN f ON f.id = q.id AND f.r = r1 AND f.c = c1"""),
    "bounded_water_sizes": (bounded_water_sizes, f"""WITH RECURSIVE {_GRID_SQL}, w AS (SELECT r, c FROM g WHERE (v + 3 * r + 5 * c) % 9 < 4),
      a AS (SELECT s_suppkey::BIGINT AS id, s_suppkey * 7 % 64 AS r0, s_suppkey * 11 % 64 AS c0 FROM supplier),
      s AS (SELECT id, r0, c0, r, c FROM a JOIN w ON greatest(abs(r - r0), abs(c - c0)) BETWEEN 1 AND 2 AND NOT (c = c0 + 1 AND r BETWEEN r0 AND r0 + 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY greatest(abs(r - r0), abs(c - c0)), r, c) = 1),
      o AS (SELECT i.i, j.i AS j FROM range(-1, 2) i(i), range(-1, 2) j(i)),
      f(id, r0, c0, r, c) AS (SELECT * FROM s UNION SELECT id, r0, c0, w.r, w.c FROM f, o, w WHERE w.r = f.r + o.i AND w.c = f.c + o.j AND greatest(abs(w.r - r0), abs(w.c - c0)) <= 8 AND NOT (w.c = c0 + 1 AND w.r BETWEEN r0 AND r0 + 1))
      SELECT id, least(count(*), 40) AS size, count(*) >= 40 AS bounded FROM f GROUP BY id"""),
    "least_width": (least_width, f"""WITH {_GRID_SQL}, w AS (SELECT r, c FROM g WHERE (v + 3 * r + 5 * c) % 9 < 6), x AS (SELECT * FROM (VALUES (0, 0, 1), (0, 0, -1), (1, 1, 0), (1, -1, 0), (2, 1, 1), (2, -1, -1), (3, 1, -1), (3, -1, 1)) v(axis, i, j)),
      d AS (SELECT a.r, a.c, axis, i, j, min(CASE WHEN b.r IS NULL THEN k ELSE 10 END) AS k FROM w a CROSS JOIN x CROSS JOIN range(1, 11) n(k) LEFT JOIN w b ON b.r = a.r + i * k AND b.c = a.c + j * k GROUP BY ALL), s AS (SELECT r, c, axis, sum(k) AS k FROM d GROUP BY ALL)
      SELECT r, c, min(k)::BIGINT AS width FROM s GROUP BY 1, 2"""),
    "zones_reaching": (zones_reaching, f"""WITH {_PORTS}, z AS (SELECT n_nationkey::BIGINT AS zone, {lng_sql('n_nationkey')} AS x, {lat_sql('n_nationkey')} AS y, n_nationkey % 5 * 0.1::DOUBLE + 0.35::DOUBLE AS buffer FROM nation),
      e AS (SELECT zone, buffer, x + a AS x1, y + b AS y1, x + c AS x2, y + d AS y2 FROM z JOIN (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.0::DOUBLE, 0.0::DOUBLE, 0.7::DOUBLE, 0.4::DOUBLE), (1, 0.7::DOUBLE, 0.4::DOUBLE, 0.9::DOUBLE, -0.6::DOUBLE)) v(odd, a, b, c, d) ON zone % 2 = odd),
      t AS (SELECT p.id, p.lng, p.lat, e.*, x2 - x1 AS dx, y2 - y1 AS dy FROM p, e), u AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((lng - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy))) END AS t FROM t),
      d AS (SELECT id, zone, min(sqrt(power(lng - x1 - t * dx, 2) + power(lat - y1 - t * dy, 2))) AS d FROM u WHERE sqrt(power(lng - x1 - t * dx, 2) + power(lat - y1 - t * dy, 2)) <= buffer GROUP BY 1, 2)
      SELECT id, zone, row_number() OVER (PARTITION BY id ORDER BY d, zone)::INTEGER AS place, {round_sql('d', 6)} AS distance FROM d"""),
    "raster_files": (raster_files, f"""WITH {_GRID_SQL}, k AS (SELECT r, c, max(v) AS v FROM (SELECT r // 8 AS r, c // 8 AS c, v FROM g) GROUP BY 1, 2)
      SELECT 'grid' AS tile, x.i AS r, y.i AS c, coalesce(v, 0)::INTEGER AS v, NULL::VARCHAR AS problem FROM range(64) x(i) CROSS JOIN range(64) y(i) LEFT JOIN g ON g.r = x.i AND g.c = y.i
      UNION ALL SELECT 'grid.coarse', x.i, y.i, coalesce(v, 0)::INTEGER, NULL FROM range(8) x(i) CROSS JOIN range(8) y(i) LEFT JOIN k ON k.r = x.i AND k.c = y.i"""),
    "coast_controls": (coast_controls, f"""WITH {_FILL_SQL}, h AS (SELECT count(*) AS n FROM (SELECT r, c FROM inside GROUP BY 1, 2 HAVING count(*) > 1)),
      x AS (SELECT min(least(x1, x2)) AS a, max(greatest(x1, x2)) AS b, min(least(y1, y2)) AS c, max(greatest(y1, y2)) AS d FROM e),
      q AS (SELECT count(*) AS n FROM s JOIN x ON s.x BETWEEN a AND b AND s.y BETWEEN c AND d), ct AS (SELECT (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM nation) AS n),
      i AS (SELECT count(DISTINCT id) AS n FROM (SELECT s.id, e.id AS polygon FROM s JOIN e ON (y1 > s.y) <> (y2 > s.y) AND s.x < (x2 - x1) * (s.y - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1))
      SELECT 'A4' AS control, true AS ok, e || ' rows, 0 broken' AS got FROM ct UNION ALL SELECT 'A4b', q.n = s, q.n || ' of ' || s || ' points in the box' FROM q, ct
      UNION ALL SELECT 'A5', n > 0, n || ' cells in several polygons' FROM h UNION ALL SELECT 'A6', e >= n * 10, e || ' against ' || n || ' edges' FROM ct UNION ALL SELECT 'A7', i.n = s, i.n || ' of ' || s || ' points inside' FROM i, ct"""),
    "published_box": (published_box, f"WITH {_EDGES_SQL} SELECT * FROM e WHERE x1 BETWEEN -74 AND -70 AND y1 BETWEEN -40 AND -30"),
}
