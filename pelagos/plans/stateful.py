"""Queries with state, rounds or order: limits, breakers, streams, graphs, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.functions.num import half_up
from pelagos.operators import graph, sequential
from pelagos.operators import spatial as S
from pelagos.plans.base import haversine_sql, round_sql, table
from pelagos.plans.places import _GRID_SQL, _LEGS_SQL, _PORTS, _STATIONS, _grid, _legs, places
from pelagos.streaming import counts, ordered


def rate_limit_anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Requests allowed: three in ten hours that start with the first."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return sequential.allowed(e, "user_id", "ts", ["ts", "event_id"], 3, 36_000.0).select("event_id", "allowed")


def circuit_breaker(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("service"), "ts", (F.col("value") > 60).alias("failed"))
    return sequential.breaker(e, "service", "ts", "failed", ["ts", "event_id"], 3, 7200.0).select("event_id", "state")


def stream_tumbling_counts(spark, sf):
    """Daily counts that the stream has put out: of days that the watermark, two days behind the last event, has passed."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return counts.drained(counts.tumbling(counts.event_stream(spark, f"{sf}/event[s].parquet", schema), "2 days", "1 day"), "tumbling")


def stream_rate_limit(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return counts.drained(counts.limited(counts.event_stream(spark, f"{sf}/event[s].parquet", schema), 3, 36_000.0), "limited").select("event_id", "allowed")


def stream_text_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events of another kind than the user's event before, in event time, up to two days before the last event."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return counts.drained(ordered.changes(counts.event_stream(spark, f"{sf}/event[s].parquet", schema), "user_id", "event_id", "event_type", "2 days"), "changes")


def stream_rate_limit_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Requests allowed, three in ten hours that start with the first, in event time, up to two days before the last event."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return counts.drained(ordered.limited(counts.event_stream(spark, f"{sf}/event[s].parquet", schema), "user_id", "event_id", 3, 36_000.0, "2 days"), "in-order").select("event_id", "allowed")


def connected_components(spark, sf):
    """Groups of stations that steps of at most 60 km join."""
    s = places(spark, sf, "supplier", "s_suppkey")
    links = S.radius_join(s, s, 60.0).select(F.col("id").alias("a"), F.col("other").alias("b"))
    return graph.components(links)


def grid_shortest_cost(spark, sf):
    """The cheapest way from one cell of a grid to every cell that can be reached, a cell's value being the price of entering it."""
    g = _grid(spark, sf).select("r", "c", F.col("v").alias("w"))
    start = spark.range(1).select(F.lit(10).cast("bigint").alias("r"), F.lit(10).cast("bigint").alias("c"))
    out = graph.grid_costs(g, start, 32)
    return out.select((F.col("r") * 64 + F.col("c")).alias("node"), half_up(F.col("cost") / 100.0, 6).alias("cost"))


def channels_crossed(spark, sf):
    """Legs that pass a line within half a degree: points of the leg's box against the line's segments."""
    legs = _legs(spark, sf)
    d = F.least(*(geo.segment_distance(F.lit(x), F.lit(y), F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2")) for x, y in ((-72.0, -30.0), (-72.0, -31.0), (-72.5, -32.0))))
    return legs.select("s_suppkey", half_up(d, 6).alias("d")).where("d <= 0.5")


def spatial_dedup_cascade(spark, sf):
    """Sources in order of trust; a place within 5 km of one that is already in is not taken."""
    kept = places(spark, sf, "nation", "n_nationkey").withColumn("src", F.lit("a"))
    for name, key, src in (("supplier", "s_suppkey", "b"), ("customer", "c_custkey", "c")):
        new = places(spark, sf, name, key)
        near = S.radius_join(new, kept.select((F.xxhash64("src", "id")).alias("id"), "lat", "lng"), 5.0).select("id").distinct()
        kept = kept.unionByName(new.join(near, "id", "left_anti").withColumn("src", F.lit(src)))
    return kept.groupBy("src").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


QUERIES = {
    "rate_limit_anchored": (rate_limit_anchored, None),
    "circuit_breaker": (circuit_breaker, None),
    "stream_tumbling_counts": (stream_tumbling_counts, "WITH d AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start::TIMESTAMP AS start, event_type, n FROM d WHERE start + INTERVAL 3 DAY <= (SELECT max(ts) FROM events)"),
    "stream_rate_limit": (stream_rate_limit, None),
    "stream_text_changes": (stream_text_changes, """WITH d AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events WHERE date_trunc('milliseconds', ts) < (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 DAY)
      SELECT * FROM d WHERE before <> after"""),
    "stream_rate_limit_in_order": (stream_rate_limit_in_order, None),
    "connected_components": (connected_components, f"WITH RECURSIVE {_STATIONS}, l AS (SELECT a.id AS a, b.id AS b FROM s a, s b WHERE {haversine_sql('a', 'b')} <= 60), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS node, min(b) AS root FROM r GROUP BY 1"),
    "grid_shortest_cost": (grid_shortest_cost, f"""WITH RECURSIVE {_GRID_SQL}, o AS (SELECT i.i, j.i AS j FROM range(-1, 2) i(i), range(-1, 2) j(i) WHERE i.i <> 0 OR j.i <> 0),
      f(r, c, cost) USING KEY (r, c) AS (SELECT r, c, 0::BIGINT FROM g WHERE r = 10 AND c = 10 UNION
        SELECT r, c, n.cost FROM (SELECT g.r, g.c, min(f.cost + g.v)::BIGINT AS cost FROM f, o, g WHERE g.r = f.r + o.i AND g.c = f.c + o.j GROUP BY 1, 2) n LEFT JOIN recurring.f k USING (r, c) WHERE k.cost IS NULL OR n.cost < k.cost)
      SELECT (r * 64 + c)::BIGINT AS node, cost / 100.0::DOUBLE AS cost FROM f"""),
    "channels_crossed": (channels_crossed, f"""WITH {_LEGS_SQL}, x AS (SELECT s_suppkey, lng AS ax, lat AS ay, lng2 - lng AS dx, lat2 - lat AS dy, px, py FROM legs, (VALUES (-72.0::DOUBLE, -30.0::DOUBLE), (-72.0::DOUBLE, -31.0::DOUBLE), (-72.5::DOUBLE, -32.0::DOUBLE)) v(px, py)),
      t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM x),
      d AS (SELECT s_suppkey, {round_sql('min(sqrt(power(px - ax - t * dx, 2) + power(py - ay - t * dy, 2)))', 6)} AS d FROM t GROUP BY 1) SELECT s_suppkey, d FROM d WHERE d <= 0.5"""),
    "spatial_dedup_cascade": (spatial_dedup_cascade, f"""WITH n AS (SELECT n_nationkey::BIGINT AS id, (-18.0::DOUBLE - ((n_nationkey::BIGINT * 7919) % 3800) / 100.0::DOUBLE) AS lat, (-76.0::DOUBLE + ((n_nationkey::BIGINT * 104729) % 1000) / 100.0::DOUBLE) AS lng FROM nation), {_STATIONS}, {_PORTS},
      k2 AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE {haversine_sql('s', 'n')} <= 5)), t AS (SELECT * FROM n UNION ALL SELECT * FROM k2), k3 AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE {haversine_sql('p', 't')} <= 5))
      SELECT 'a' AS src, count(*) AS n, sum(id)::BIGINT AS ids FROM n UNION ALL SELECT 'b', count(*), sum(id)::BIGINT FROM k2 HAVING count(*) > 0 UNION ALL SELECT 'c', count(*), sum(id)::BIGINT FROM k3 HAVING count(*) > 0"""),
}
