"""Queries on formats, nested values, grid cells and rules that tables must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions.num import half_up
from pelagos.operators import restrictions as R
from pelagos.operators import spatial as S
from pelagos.plans.base import feed, lat, lat_sql, lng, lng_sql, round_sql, table
from pelagos.plans.places import _BOX_SQL, _GRID_SQL, _LEGS_SQL, _boxes, _grid, _legs
from pelagos.plans.restrictions import NORM_SQL

W_ = W.Window
# The ellipsoid's radius and squared eccentricity, and the scale of the projection.
_A, _E2, _K0 = 6378137.0, 0.00669437999014, 0.9996


def utm_to_latlng(spark: SparkSession, sf: str) -> DataFrame:
    """Zone 18 south: northing and easting to degrees by the inverse series."""
    s = table(spark, sf, "supplier").select("s_suppkey", (F.lit(400_000.0) + F.col("s_suppkey") % 900 * 200).alias("x"), (F.lit(5_000_000.0) + F.col("s_suppkey") % 700 * 1000).alias("y"))
    e1 = (1 - (1 - _E2) ** 0.5) / (1 + (1 - _E2) ** 0.5)
    mu = (F.col("y") - 1e7) / _K0 / (_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    p = mu + (1.5 * e1 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu)
    s = s.withColumn("p", p)
    ep = _E2 / (1 - _E2)
    s = s.withColumns({"n": _A / F.sqrt(1 - _E2 * F.pow(F.sin("p"), 2)), "t": F.pow(F.tan("p"), 2), "c": ep * F.pow(F.cos("p"), 2), "r": _A * (1 - _E2) / F.pow(1 - _E2 * F.pow(F.sin("p"), 2), 1.5)})
    s = s.withColumn("d", (F.col("x") - 500_000.0) / (F.col("n") * _K0))
    d, t, c = F.col("d"), F.col("t"), F.col("c")
    la = F.col("p") - F.col("n") * F.tan("p") / F.col("r") * (F.pow(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(d, 4) / 24)
    lo = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6) / F.cos("p")
    return s.select("s_suppkey", half_up(F.degrees(la), 6).alias("lat"), half_up(F.degrees(lo) - 75, 6).alias("lng"))


def any_point_in_bbox(spark, sf):
    """Nations with a customer in the box."""
    c = table(spark, sf, "customer")
    inside = lat("c_custkey").between(-30, -28) & lng("c_custkey").between(-74, -72)
    return c.where(inside).select("c_nationkey").distinct()


def _crossed(spark, sf):
    legs = _legs(spark, sf).select(F.col("s_suppkey").alias("id"), (F.col("lng") + 0.0037).alias("x1"), (F.col("lat") + 0.0023).alias("y1"), (F.col("lng2") + 0.0041).alias("x2"), (F.col("lat2") + 0.0029).alias("y2"))
    edges = _boxes(spark, sf).withColumnRenamed("polygon", "id")
    return legs, S.crossings(legs, edges, 1.0)


def line_polygon_intersects(spark, sf):
    """Legs that cross a polygon's edge or start in it."""
    legs, crossed = _crossed(spark, sf)
    inside = S.points_in_polygons(legs.select("id", F.col("x1").alias("x"), F.col("y1").alias("y")), _boxes(spark, sf), 0.5)
    return crossed.select("id", F.col("other").alias("polygon")).union(inside).distinct()


def crossed_ways(spark, sf):
    """How many polygons each leg crosses, and the first by number."""
    _, crossed = _crossed(spark, sf)
    return crossed.groupBy("id").agg(F.count("*").alias("ways"), F.min("other").alias("first"))


def segment_midpoint_sample(spark, sf):
    """The hour at which eight knots reach the middle of each leg."""
    w = W_.partitionBy("route").orderBy("seq").rowsBetween(W_.unboundedPreceding, -1)
    legs = _legs(spark, sf).withColumn("before", F.coalesce(F.sum("nm").over(w), F.lit(0.0)))
    return legs.select("s_suppkey", half_up((F.col("before") + F.col("nm") / 2) / 8, 6).alias("hour"))


def scanline_profile(spark, sf):
    """The westernmost customer within half a degree of each parallel."""
    lines = spark.range(38).select((F.lit(-18.0) - F.col("id")).alias("parallel"), F.col("id").alias("line"))
    c = table(spark, sf, "customer").select(lat("c_custkey").alias("lat"), lng("c_custkey").alias("lng")).withColumn("line", F.explode(F.array(F.floor(-18.0 - F.col("lat")), F.floor(-18.0 - F.col("lat")) + 1)))
    near = c.join(lines, "line").where(F.abs(F.col("lat") - F.col("parallel")) <= 0.5)
    return near.groupBy("parallel").agg(half_up(F.min("lng"), 6).alias("west"), F.count("*").alias("n"))


def closure_record(spark, sf):
    """State, way it was told and scope of each restriction in one line."""
    n = R.normalized(feed(spark, sf))
    closed = F.coalesce(F.upper("observation").contains("PUERTO CERRADO"), F.lit(False)) | (F.col("condition").isin("TEMPORAL", "MAL_TIEMPO") & F.col("total"))
    scope = F.when(F.col("total"), "total").when(F.col("outside").isNotNull(), F.concat(F.lit("umbral "), F.col("outside").cast("string"))).when(F.col("minors"), "menores").otherwise("no_legible")
    return n.select("id", F.concat_ws("|", F.when(closed, "closed").otherwise("open"), scope, F.col("zone")).alias("record"))


def tolerance_check(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 3.2).alias("want"), (F.col("p_retailprice") / 10).alias("got"))
    return p.select("p_partkey", (F.abs(F.col("got") - F.col("want")) <= 0.15 * F.col("want")).alias("ok"))


def duration_format(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 5000).cast("int").alias("m"))
    return e.select("event_id", F.concat(F.floor(F.col("m") / 60).cast("string"), F.lit("h "), F.lpad((F.col("m") % 60).cast("string"), 2, "0"), F.lit("m")).alias("said"))


def eta_timestamp(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 72).cast("int"))).alias("eta"))


def json_path_get(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.a.b").alias("deep"))


def unknown_keys(spark, sf):
    """Keys of the JSON that the contract does not know."""
    e = table(spark, sf, "events").select(F.explode(F.array_except(F.json_object_keys("props"), F.array(F.lit("id"), F.lit("v")))).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n"))


def array_dedup_by_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return d.select("doc_id", F.size("lines").cast("bigint").alias("n"), F.size(F.array_distinct("lines")).cast("bigint").alias("distinct_n"))


def identity_margin(spark, sf):
    """Stations whose nearest neighbour is at least three times as far as they were moved."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), lat("s_suppkey").alias("lat"), lng("s_suppkey").alias("lng"))
    near = S.radius_join(s, s, 900.0).where("id <> other").groupBy("id").agg(F.min("km").alias("km"))
    return near.select("id", (F.col("km") >= 3.0 * (F.col("id") % 20)).alias("safe"))


def _offsets(df: DataFrame, reach: int) -> DataFrame:
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))


def snap_cell(spark, sf):
    """The free cell nearest to each blocked one by rings, ties by row and column offset."""
    g = _grid(spark, sf)
    near = _offsets(g.where("v >= 4980").select("r", "c"), 3).select("r", "c", "dr", "dc", (F.col("r") + F.col("dr")).alias("r2"), (F.col("c") + F.col("dc")).alias("c2"))
    free = g.where("v < 4980").select(F.col("r").alias("r2"), F.col("c").alias("c2"))
    best = F.min(F.struct(F.greatest(F.abs("dr"), F.abs("dc")).alias("ring"), "dr", "dc", "r2", "c2"))
    return near.join(free, ["r2", "c2"]).groupBy("r", "c").agg(best.alias("b")).select("r", "c", "b.r2", "b.c2")


def grid_distance(spark, sf):
    """The distance of free cells to the nearest blocked one, as far as four cells."""
    g = _grid(spark, sf)
    near = _offsets(g.where("v >= 4980").select("r", "c"), 4).select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"))
    return g.where("v < 4980").select("r", "c").join(near, ["r", "c"]).groupBy("r", "c").agg(half_up(F.sqrt(F.min("d2")), 6).alias("cells"))


def mask_impact(spark, sf):
    """How many cells of each row a mask takes away, the rows hit hardest first."""
    g = _grid(spark, sf)
    mask = g.where("v >= 4900").select("r", "c")
    left = g.join(mask, ["r", "c"], "left_anti").groupBy("r").agg(F.count("*").alias("left_n"))
    rows = g.groupBy("r").agg(F.count("*").alias("n")).join(left, "r", "left").withColumn("left_n", F.coalesce("left_n", F.lit(0)))
    return rows.select("r", half_up(100.0 * (F.col("n") - F.col("left_n")) / F.col("n"), 4).alias("pct")).orderBy(F.desc("pct"), "r").limit(10)


def bidirectional_fk(spark, sf):
    """Keys that one side has and the other does not, both ways."""
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    one = a.join(b, "k", "left_anti").agg(F.count("*").alias("n")).withColumn("side", F.lit("without orders"))
    return one.unionByName(b.join(a, "k", "left_anti").agg(F.count("*").alias("n")).withColumn("side", F.lit("without customer")))


def required_if(spark, sf):
    """Where the status asks for a clerk's class, its absence is a fault."""
    o = table(spark, sf, "orders").withColumn("clerk", F.when(F.col("o_orderkey") % 6 != 0, "c"))
    return o.groupBy("o_orderpriority").agg(F.count_if((F.col("o_orderstatus") == "F") & F.col("clerk").isNull()).alias("faults"))


_E1 = (1 - (1 - _E2) ** 0.5) / (1 + (1 - _E2) ** 0.5)
_EP = _E2 / (1 - _E2)
_N = lambda x: f"{x!r}::DOUBLE"
QUERIES = {
    "utm_to_latlng": (utm_to_latlng, f"""WITH a AS (SELECT s_suppkey, 400000.0::DOUBLE + s_suppkey % 900 * 200 AS x, ((5000000.0::DOUBLE + s_suppkey % 700 * 1000) - 10000000) / {_N(_K0)} / {_N(_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))} AS m FROM supplier),
      b AS (SELECT *, m + {_N(1.5 * _E1 - 27 * _E1**3 / 32)} * sin(2 * m) + {_N(21 * _E1**2 / 16 - 55 * _E1**4 / 32)} * sin(4 * m) + {_N(151 * _E1**3 / 96)} * sin(6 * m) AS p FROM a),
      c AS (SELECT *, {_N(_A)} / sqrt(1 - {_N(_E2)} * power(sin(p), 2)) AS n, power(tan(p), 2) AS t, {_N(_EP)} * power(cos(p), 2) AS c, {_N(_A * (1 - _E2))} / power(1 - {_N(_E2)} * power(sin(p), 2), 1.5) AS r FROM b),
      d AS (SELECT *, (x - 500000) / (n * {_N(_K0)}) AS d FROM c)
      SELECT s_suppkey, {round_sql(f"degrees(p - n * tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - {_N(9 * _EP)}) * power(d, 4) / 24))", 6)} AS lat, {round_sql("degrees((d - (1 + 2 * t + c) * power(d, 3) / 6) / cos(p)) - 75", 6)} AS lng FROM d"""),
    "any_point_in_bbox": (any_point_in_bbox, f"SELECT DISTINCT c_nationkey FROM customer WHERE {lat_sql('c_custkey')} BETWEEN -30 AND -28 AND {lng_sql('c_custkey')} BETWEEN -74 AND -72"),
    "segment_midpoint_sample": (segment_midpoint_sample, f"WITH {_LEGS_SQL} SELECT s_suppkey, {round_sql('(coalesce(sum(nm) OVER (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + nm / 2) / 8', 6)} AS hour FROM legs"),
    "scanline_profile": (scanline_profile, f"WITH c AS (SELECT {lat_sql('c_custkey')} AS lat, {lng_sql('c_custkey')} AS lng FROM customer), p AS (SELECT -18.0::DOUBLE - i AS parallel FROM range(38) r(i)) SELECT parallel, {round_sql('min(lng)', 6)} AS west, count(*) AS n FROM p JOIN c ON abs(lat - parallel) <= 0.5 GROUP BY 1"),
    "closure_record": (closure_record, f"WITH {NORM_SQL} SELECT id, CASE WHEN contains(coalesce(upper(observation), ''), 'PUERTO CERRADO') OR (condition IN ('TEMPORAL', 'MAL_TIEMPO') AND total) THEN 'closed' ELSE 'open' END || '|' || CASE WHEN total THEN 'total' WHEN outside IS NOT NULL THEN 'umbral ' || outside WHEN minors THEN 'menores' ELSE 'no_legible' END || '|' || zone AS record FROM norm"),
    "tolerance_check": (tolerance_check, "SELECT p_partkey, abs(p_retailprice / 10 - p_size * 3.2::DOUBLE) <= 0.15::DOUBLE * (p_size * 3.2::DOUBLE) AS ok FROM part"),
    "duration_format": (duration_format, "SELECT event_id, (event_id % 5000 // 60) || 'h ' || lpad((event_id % 5000 % 60)::VARCHAR, 2, '0') || 'm' AS said FROM events"),
    "eta_timestamp": (eta_timestamp, "SELECT o_orderkey, o_orderdate + to_hours((o_custkey % 72)::INT) AS eta FROM orders"),
    "json_path_get": (json_path_get, "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.a.b') AS deep FROM events"),
    "unknown_keys": (unknown_keys, "WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n FROM k WHERE key NOT IN ('id', 'v') GROUP BY 1"),
    "array_dedup_by_text": (array_dedup_by_text, "SELECT doc_id, len(string_split(text, chr(10))) AS n, len(list_distinct(string_split(text, chr(10)))) AS distinct_n FROM documents"),
    "identity_margin": (identity_margin, f"WITH s AS (SELECT s_suppkey AS id, {lat_sql('s_suppkey')} AS lat, {lng_sql('s_suppkey')} AS lng FROM supplier), d AS (SELECT a.id, min(2 * 6371.0::DOUBLE * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2)))) AS km FROM s a JOIN s b ON a.id <> b.id GROUP BY 1) SELECT id, km >= 3 * (id % 20) AS safe FROM d WHERE km <= 900"),
    "snap_cell": (snap_cell, f"WITH {_GRID_SQL}, n AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, row_number() OVER (PARTITION BY a.r, a.c ORDER BY greatest(abs(b.r - a.r), abs(b.c - a.c)), b.r - a.r, b.c - a.c) AS k FROM g a JOIN g b ON abs(b.r - a.r) <= 3 AND abs(b.c - a.c) <= 3 WHERE a.v >= 4980 AND b.v < 4980) SELECT r, c, r2, c2 FROM n WHERE k = 1"),
    "grid_distance": (grid_distance, f"WITH {_GRID_SQL} SELECT a.r, a.c, {round_sql('sqrt(min((b.r - a.r) * (b.r - a.r) + (b.c - a.c) * (b.c - a.c)))', 6)} AS cells FROM g a JOIN g b ON abs(b.r - a.r) <= 4 AND abs(b.c - a.c) <= 4 WHERE a.v < 4980 AND b.v >= 4980 GROUP BY 1, 2"),
    "mask_impact": (mask_impact, f"WITH {_GRID_SQL} SELECT r, {round_sql('100.0::DOUBLE * count(*) FILTER (WHERE v >= 4900) / count(*)', 4)} AS pct FROM g GROUP BY r ORDER BY pct DESC, r LIMIT 10"),
    "bidirectional_fk": (bidirectional_fk, "SELECT count(*) AS n, 'without orders' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT count(DISTINCT o_custkey), 'without customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "required_if": (required_if, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 6 = 0) AS faults FROM orders GROUP BY 1"),
}
_CROSS_SQL = f"""WITH {_BOX_SQL}, {_LEGS_SQL}, l AS (SELECT s_suppkey AS id, lng + 0.0037::DOUBLE AS px, lat + 0.0023::DOUBLE AS py, lng2 + 0.0041::DOUBLE AS qx, lat2 + 0.0029::DOUBLE AS qy FROM legs),
x AS (SELECT DISTINCT l.id, e.polygon FROM l, e WHERE sign((qx - px) * (y1 - py) - (qy - py) * (x1 - px)) * sign((qx - px) * (y2 - py) - (qy - py) * (x2 - px)) < 0 AND sign((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) * sign((x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1)) < 0)"""
QUERIES["crossed_ways"] = (crossed_ways, _CROSS_SQL + " SELECT id, count(*) AS ways, min(polygon) AS first FROM x GROUP BY 1")
QUERIES["line_polygon_intersects"] = (line_polygon_intersects, _CROSS_SQL + " SELECT id, polygon FROM x UNION SELECT l.id, c.polygon FROM l, c WHERE abs(px - c.lng) / 1.5 + abs(py - c.lat) / 2 < 1")
