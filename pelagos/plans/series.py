"""Queries on time series, tides, passage planning and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import tide
from pelagos.functions.num import half_up
from pelagos.plans.base import round_sql, table
from pelagos.plans.places import _LEGS_SQL, _legs

W_ = W.Window


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _micros():
    """``ts`` in microseconds since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def _station(order=("ts", "event_id")):
    return W_.partitionBy("user_id").orderBy(*order)


def hourly_resample(spark, sf):
    e = _events(spark, sf)
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(half_up(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def sigma_filter(spark, sf):
    """Values within three standard deviations of their type's mean."""
    e = _events(spark, sf)
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return e.join(F.broadcast(s), "event_type").where(F.abs(F.col("value") - F.col("m")) <= 3 * F.col("s")).groupBy("event_type").agg(F.count("*").alias("kept"))


def stuck_run_filter(spark, sf):
    """Runs of four or more readings that hardly move are dropped, their first reading too."""
    e = _events(spark, sf).withColumn("still", F.abs(F.col("value") - F.lag("value").over(_station())) < 15)
    e = e.withColumn("run", F.sum((~F.coalesce("still", F.lit(False))).cast("int")).over(_station()))
    e = e.withColumn("n", F.count("*").over(W_.partitionBy("user_id", "run")))
    return e.where("n < 4").groupBy("user_id").agg(F.count("*").alias("kept"))


def gap_count(spark, sf):
    e = _events(spark, sf).withColumn("before", F.lag("ts").over(_station()))
    return e.groupBy("user_id").agg(F.count_if(F.col("ts") > F.col("before") + F.expr("interval 2 days")).alias("gaps"))


def next_high_low(spark, sf):
    """The first turning points of a station's series."""
    e = _events(spark, sf).withColumns({"p": F.lag("value").over(_station()), "n": F.lead("value").over(_station())})
    v = F.col("value")
    high = (v >= F.col("p")) & (v >= F.col("n")) & (v > F.col("p"))
    low = (v <= F.col("p")) & (v <= F.col("n")) & (v < F.col("p"))
    return e.groupBy("user_id").agg(F.min(F.when(high, F.col("ts"))).alias("high"), F.min(F.when(low, F.col("ts"))).alias("low"))


def trend_sign(spark, sf):
    e = _events(spark, sf).withColumn("n", F.lead("value").over(_station()))
    return e.where("n is not null").groupBy(F.when(F.col("n") >= F.col("value"), "rising").otherwise("falling").alias("trend")).agg(F.count("*").alias("n"))


def consecutive_dedup(spark, sf):
    """A station is listed again only when another was in between; readings without one do not count."""
    e = _events(spark, sf).where("value > 20").withColumn("before", F.lag("event_type").over(_station()))
    return e.where("before is null or before <> event_type").select("event_id")


def runs_by_level(spark, sf):
    level = F.floor(F.col("value") / 50)
    e = _events(spark, sf).withColumn("level", level).withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(_station()), F.lit(-1))).cast("int"))
    e = e.withColumn("run", F.sum("new").over(_station()))
    return e.groupBy("user_id", "run").agg(F.first("level").alias("level"), F.count("*").alias("n"), F.min("ts").alias("start")).select("user_id", F.col("run").cast("bigint").alias("run"), F.col("level").cast("bigint").alias("level"), "n", "start")


def below_threshold_runs(spark, sf):
    low = (F.col("value") < 30).cast("int")
    e = _events(spark, sf).withColumn("low", low).withColumn("new", (F.col("low") != F.coalesce(F.lag("low").over(_station()), F.lit(-1))).cast("int"))
    e = e.withColumn("run", F.sum("new").over(_station())).where("low = 1")
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.min_by("event_id", F.struct("value", "ts", "event_id")).alias("place")).drop("run")


def linear_interpolate(spark, sf):
    """The value at fixed hours, on the line between the readings around, or that of the nearest end."""
    e = _events(spark, sf).where("event_type = 'click'")
    s = e.groupBy(F.col("user_id") % 20, "ts").agg(F.avg("value").alias("v")).withColumnRenamed("(user_id % 20)", "st").select("st", _micros().alias("t"), "v")
    span = s.groupBy("st").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    grid = span.select("st", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"), (F.col("a") + F.expr("div(z - a, 20)") * (F.col("i") - 2)).alias("t"))
    u = s.withColumn("i", F.lit(None).cast("int")).unionByName(grid.withColumn("v", F.lit(None).cast("double")))
    w = W_.partitionBy("st").orderBy("t", F.col("i").isNotNull().cast("int"))
    got = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    u = u.withColumns({"p": F.last(got, True).over(w), "n": F.first(got, True).over(w.rowsBetween(0, W_.unboundedFollowing))}).where("i is not null")
    line = F.when(F.col("p").isNull(), F.col("n.v")).when(F.col("n").isNull() | (F.col("p.t") == F.col("t")), F.col("p.v"))
    line = line.otherwise(F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t")))
    return u.select("st", F.col("i").cast("bigint").alias("i"), half_up(line, 4).alias("v"))


def uv_decompose(spark, sf):
    e = _events(spark, sf).withColumn("d", F.col("event_id") * 37 % 360)
    return e.select("event_id", half_up(F.col("value") * F.sin(F.radians("d")), 6).alias("u"), half_up(F.col("value") * F.cos(F.radians("d")), 6).alias("v"))


def time_grid(spark, sf):
    e = _events(spark, sf).groupBy("event_type").agg(F.date_trunc("hour", F.min("ts")).alias("a"))
    return e.select("event_type", F.explode(F.sequence("a", F.col("a") + F.expr("interval 30 hours"), F.expr("interval 30 minutes"))).alias("ts"))


def best_sensor(spark, sf):
    n = _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("m")).select("user_id", "m.event_type")


def fit_r2(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(half_up(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


# Amplitudes in millimetres, speeds in degrees an hour and phases of five constituents.


#: Amplitudes in millimetres and phases in degrees of an open coast: constituent, amplitude, phase.
_HARMONICS = (("M2", 410.0, 12.0), ("S2", 150.0, 35.0), ("N2", 95.0, 350.0), ("K2", 41.0, 33.0), ("K1", 160.0, 210.0), ("O1", 105.0, 170.0), ("P1", 52.0, 208.0), ("Q1", 21.0, 150.0), ("M4", 9.0, 80.0), ("MS4", 6.0, 110.0), ("SSA", 30.0, 20.0))


def tide_height(spark, sf):
    """Mean level and the sum of the constituents' amplitudes by node factor and the cosine of argument, node phase and phase lag."""
    e = table(spark, sf, "events").select("event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("seconds"))
    return tide.heights(e, "seconds", 900.0, _HARMONICS).select("event_id", half_up(F.col("height"), 3).alias("mm"))


def _height_sql() -> str:
    inner = "SELECT event_id, floor(epoch_us(ts) / 1000000.0::DOUBLE)::BIGINT AS seconds FROM events"
    for step in tide.steps("seconds"):
        inner = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM ({inner})"
    each = ", ".join(f"('{n}', {a}::DOUBLE, {g}::DOUBLE)" for n, a, g in _HARMONICS)
    rows = " UNION ALL ".join(f"SELECT event_id, '{n}' AS name, v_{n} AS v, fa_{n} AS f, ua_{n} AS u FROM a" for n, _, _ in _HARMONICS)
    return f"WITH a AS ({inner}), e AS ({rows}), h(name, amplitude, lag) AS (VALUES {each}) SELECT event_id, {round_sql('900 + sum(amplitude * f * cos(radians(v + u - lag)))', 3)} AS mm FROM e JOIN h USING (name) GROUP BY event_id"


def tumbling_counts(spark, sf):
    w = F.window("ts", "15 minutes")
    return _events(spark, sf).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(spark, sf):
    w = F.window("ts", "1 hour", "30 minutes")
    return _events(spark, sf).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(spark, sf):
    w = F.session_window("ts", "30 minutes")
    return _events(spark, sf).groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def ttl_dedup(spark, sf):
    """A reading counts unless one of its station and type came in the six hours before."""
    w = W_.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = _events(spark, sf).withColumn("before", F.lag("ts").over(w))
    return e.where("before is null or ts > before + interval 6 hours").groupBy("event_type").agg(F.count("*").alias("n"))


def max_concurrency(spark, sf):
    """How many requests are open at most, each for five minutes, by type."""
    e = _events(spark, sf)
    ends = e.select("event_type", "ts", F.lit(1).alias("d")).union(e.select("event_type", F.col("ts") + F.expr("interval 5 minutes"), F.lit(-1)))
    steps = ends.groupBy("event_type", "ts").agg(F.sum("d").alias("d"))
    open_ = F.sum("d").over(W_.partitionBy("event_type").orderBy("ts"))
    return steps.withColumn("open", open_).groupBy("event_type").agg(F.max("open").alias("most"))


def backoff_schedule(spark, sf):
    e = _events(spark, sf).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return e.select("event_id", F.col("attempt").cast("bigint").alias("attempt"), (F.lit(2000) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("bigint").alias("wait_ms"))


def json_field_counts(spark, sf):
    e = _events(spark, sf).select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("missing"))


def segment_sog(spark, sf):
    """Speed over ground from speed through water and drift; none where the drift outruns the vessel."""
    legs = _legs(spark, sf).withColumn("b", F.pmod(F.degrees(F.atan2(F.sin(F.radians(F.col("lng2") - F.col("lng"))) * F.cos(F.radians("lat2")), F.cos(F.radians("lat")) * F.sin(F.radians("lat2")) - F.sin(F.radians("lat")) * F.cos(F.radians("lat2")) * F.cos(F.radians(F.col("lng2") - F.col("lng"))))), F.lit(360.0)))
    dx, dy = (F.col("s_suppkey") % 7 - 3) * 0.8, (F.col("s_suppkey") % 11 - 5) * 0.6
    legs = legs.withColumn("drift", F.sqrt(dx * dx + dy * dy)).withColumn("alpha", F.radians(F.col("b") - F.degrees(F.atan2(dx, dy))))
    rest = F.lit(4.0) - F.pow(F.col("drift") * F.sin("alpha"), 2)
    sog = F.when(rest >= 0, F.col("drift") * F.cos("alpha") + F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(0.0)
    return legs.select("route", "s_suppkey", "nm", half_up(sog, 4).alias("sog"), (rest < 0).alias("alert"))


def navigation_totals(spark, sf):
    s = segment_sog(spark, sf)
    hours = F.when(F.col("sog") > 0.01, F.col("nm") / F.col("sog"))
    return s.groupBy("route").agg(half_up(F.sum("nm"), 2).alias("nm"), half_up(F.coalesce(F.sum(hours), F.lit(0.0)), 2).alias("hours"), F.bool_or("alert").alias("alert"))


def fuel_rate(spark, sf):
    s = table(spark, sf, "supplier")
    stw, load = 4.0 + F.col("s_suppkey") % 9, 1 + (F.col("s_suppkey") % 5) / 10.0
    return s.select("s_suppkey", half_up(12.0 * F.pow(stw / 8.0, 3) * F.pow(load, 0.65), 6).alias("rate"))


def eta_stepwise(spark, sf):
    e = _events(spark, sf)
    swell, wind = F.col("event_id") % 40 / 10.0, F.col("value") / 10
    factor = F.when(swell > 2.5, 0.7).when(swell > 1.5, 0.85).otherwise(1.0) * F.when(wind > 15, 0.9).otherwise(1.0)
    return e.select("event_id", half_up(100 / (8.0 * factor), 6).alias("hours"))


# Lengths in metres up to which a tonnage holds.
_LENGTHS = ((8, 5.0), (9, 7.5), (10, 10.0), (11, 12.5), (12, 15.0), (13, 17.5), (14, 20.0), (15, 22.3), (16, 25.0), (17, 27.5), (18, 30.5), (19, 33.5), (20, 36.5), (21, 39.5), (22, 42.5), (23, 45.5), (23.99, 50.0))


def band_lookup(spark, sf):
    """The tonnage of the first length that is not exceeded; none from 24 on."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 0.5 + 0.3).alias("length"))
    found = reduce(lambda c, b: c.when(F.col("length") <= b[0], b[1]), _LENGTHS[1:], F.when(F.col("length") <= _LENGTHS[0][0], _LENGTHS[0][1]))
    return p.select("p_partkey", F.when((F.col("length") > 0) & (F.col("length") < 24), found).alias("tonnage"))


# Miles from the coast that licences and classes allow; infinite where there is no limit.
_LICENCES = (("PLDB", 0.0), ("PDB", 0.0), ("CDC", 60.0), ("CDAM", float("inf")))
_CLASSES = (("ALTA_MAR", float("inf")), ("COSTERA_60", 60.0), ("COSTERA_12", 12.0), ("BAHIA_MOTOR", 0.0))


def effective_limit(spark, sf):
    c = table(spark, sf, "customer")
    licence = reduce(lambda w, x: w.when(F.col("c_custkey") % 4 == x[0], x[1][1]), list(enumerate(_LICENCES))[1:], F.when(F.col("c_custkey") % 4 == 0, _LICENCES[0][1]))
    kind = reduce(lambda w, x: w.when(F.col("c_nationkey") % 4 == x[0], x[1][1]), list(enumerate(_CLASSES))[1:], F.when(F.col("c_nationkey") % 4 == 0, _CLASSES[0][1]))
    c = c.select("c_custkey", licence.alias("licence"), kind.alias("kind"))
    low = F.least("licence", "kind")
    said = F.when(low == 0, "bahía").when(low == float("inf"), "sin límite").otherwise(F.concat(low.cast("int").cast("string"), F.lit(" MN")))
    return c.select("c_custkey", said.alias("limit_"), F.when(F.col("licence") < F.col("kind"), "licence").when(F.col("kind") < F.col("licence"), "class").otherwise("both").alias("reason"))


def alert_level(spark, sf):
    v = F.col("value") / 3
    return _events(spark, sf).select("event_id", F.when(v >= 30, "alto").when(v >= 26, "medio").when(v >= 15, "bajo").otherwise("normal").alias("level"))


def worst_segment(spark, sf):
    """The first reading with the strongest wind of each station."""
    v = F.coalesce("value", F.lit(0.0))
    return _events(spark, sf).groupBy("user_id").agg(F.min(F.struct((-v).alias("v"), "ts", "event_id")).alias("m")).select("user_id", "m.event_id")


def range_state(spark, sf):
    p = table(spark, sf, "part")
    x = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return p.select("p_partkey", F.when(x.isNull(), "unknown").when(x.between(10, 25), "good").when(x.between(5, 35), "fair").otherwise("poor").alias("state"))


def voyage_summary(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.coalesce("l_quantity", F.lit(0.0))).alias("nm"), F.sum(F.col("l_linenumber") * 30.0).alias("minutes"), F.count("*").alias("legs")
    )
    return o.select("l_orderkey", "nm", half_up(F.col("minutes") / 60, 4).alias("hours"), half_up(F.col("nm") / (F.col("minutes") / 60), 4).alias("sog"), "legs")


_ST = "(PARTITION BY user_id ORDER BY ts, event_id)"
QUERIES = {
    "hourly_resample": (hourly_resample, f"SELECT event_type, date_trunc('hour', ts) AS hour, {round_sql('avg(value)', 6)} AS mean, count(*) AS n FROM events GROUP BY 1, 2"),
    "sigma_filter": (sigma_filter, "WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) SELECT event_type, count(*) AS kept FROM events JOIN s USING (event_type) WHERE abs(value - m) <= 3 * s GROUP BY 1"),
    "stuck_run_filter": (stuck_run_filter, f"WITH a AS (SELECT *, coalesce(abs(value - lag(value) OVER {_ST}) < 15, false) AS still FROM events), b AS (SELECT *, sum((NOT still)::INT) OVER {_ST} AS run FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM b) SELECT user_id, count(*) AS kept FROM c WHERE n < 4 GROUP BY 1"),
    "gap_count": (gap_count, f"WITH a AS (SELECT user_id, ts, lag(ts) OVER {_ST} AS b FROM events) SELECT user_id, count(*) FILTER (WHERE ts > b + INTERVAL 2 DAY) AS gaps FROM a GROUP BY 1"),
    "next_high_low": (next_high_low, f"WITH a AS (SELECT *, lag(value) OVER {_ST} AS p, lead(value) OVER {_ST} AS n FROM events) SELECT user_id, min(ts) FILTER (WHERE value >= p AND value >= n AND value > p) AS high, min(ts) FILTER (WHERE value <= p AND value <= n AND value < p) AS low FROM a GROUP BY 1"),
    "trend_sign": (trend_sign, f"WITH a AS (SELECT value, lead(value) OVER {_ST} AS n FROM events) SELECT CASE WHEN n >= value THEN 'rising' ELSE 'falling' END AS trend, count(*) AS n FROM a WHERE n IS NOT NULL GROUP BY 1"),
    "consecutive_dedup": (consecutive_dedup, f"SELECT event_id FROM events WHERE value > 20 QUALIFY lag(event_type) OVER {_ST} IS DISTINCT FROM event_type"),
    "runs_by_level": (runs_by_level, f"WITH a AS (SELECT *, floor(value / 50)::BIGINT AS level FROM events), b AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER {_ST} THEN 1 ELSE 0 END AS new FROM a), c AS (SELECT *, sum(new) OVER {_ST} AS run FROM b) SELECT user_id, run::BIGINT AS run, level, count(*) AS n, min(ts) AS start FROM c GROUP BY ALL"),
    "below_threshold_runs": (below_threshold_runs, f"WITH a AS (SELECT *, value < 30 AS low FROM events), b AS (SELECT *, CASE WHEN low IS DISTINCT FROM lag(low) OVER {_ST} THEN 1 ELSE 0 END AS new FROM a), c AS (SELECT *, sum(new) OVER {_ST} AS run FROM b WHERE true) SELECT user_id, count(*) AS n, min(value) AS least, arg_min(event_id, (value, ts, event_id)) AS place FROM c WHERE low GROUP BY user_id, run"),
    "linear_interpolate": (linear_interpolate, f"""WITH s AS (SELECT user_id % 20 AS st, epoch_us(ts) AS t, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2), span AS (SELECT st, min(t) AS a, max(t) AS z FROM s GROUP BY 1),
      g AS (SELECT st, i, a + ((z - a) // 20) * (i - 2) AS t FROM span, range(25) r(i)),
      p AS (SELECT g.st, g.i, g.t, max(s.t) FILTER (WHERE s.t <= g.t) AS pt, min(s.t) FILTER (WHERE s.t >= g.t) AS nt FROM g JOIN s USING (st) GROUP BY 1, 2, 3),
      q AS (SELECT p.*, x.v AS pv, y.v AS nv FROM p LEFT JOIN s x ON x.st = p.st AND x.t = p.pt LEFT JOIN s y ON y.st = p.st AND y.t = p.nt)
      SELECT st, i, {round_sql('CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR pt = t THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END', 4)} AS v FROM q"""),
    "uv_decompose": (uv_decompose, f"SELECT event_id, {round_sql('value * sin(radians(event_id * 37 % 360))', 6)} AS u, {round_sql('value * cos(radians(event_id * 37 % 360))', 6)} AS v FROM events"),
    "time_grid": (time_grid, "WITH a AS (SELECT event_type, date_trunc('hour', min(ts)) AS a FROM events GROUP BY 1) SELECT event_type, unnest(generate_series(a, a + INTERVAL 30 HOUR, INTERVAL 30 MINUTE)) AS ts FROM a"),
    "best_sensor": (best_sensor, "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1"),
    "fit_r2": (fit_r2, f"SELECT l_returnflag, {round_sql('regr_r2(l_extendedprice, l_quantity)', 6)} AS r2 FROM lineitem GROUP BY 1"),
    "tide_height": (tide_height, _height_sql()),
    "tumbling_counts": (tumbling_counts, "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "sliding_counts": (sliding_counts, "WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - (i * INTERVAL 30 MINUTE) AS start, event_type FROM events, range(2) r(i)) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2"),
    "session_counts": (session_counts, f"WITH a AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER {_ST} + INTERVAL 30 MINUTE OR lag(ts) OVER {_ST} IS NULL THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT *, sum(new) OVER {_ST} AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s"),
    "ttl_dedup": (ttl_dedup, "WITH a AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) SELECT event_type, count(*) AS n FROM a WHERE b IS NULL OR ts > b + INTERVAL 6 HOUR GROUP BY 1"),
    "max_concurrency": (max_concurrency, "WITH e AS (SELECT event_type, ts, 1 AS d FROM events UNION ALL SELECT event_type, ts + INTERVAL 5 MINUTE, -1 FROM events), s AS (SELECT event_type, ts, sum(d) AS d FROM e GROUP BY 1, 2), o AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY ts) AS o FROM s) SELECT event_type, max(o)::BIGINT AS most FROM o GROUP BY 1"),
    "backoff_schedule": (backoff_schedule, "SELECT event_id, i AS attempt, CAST(2000 * power(2, i - 1) AS BIGINT) AS wait_ms FROM events, range(1, 4) r(i)"),
    "json_field_counts": (json_field_counts, "WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, sum(k)::BIGINT AS total, count(*) FILTER (WHERE k IS NULL) AS missing FROM k GROUP BY 1"),
    "fuel_rate": (fuel_rate, f"SELECT s_suppkey, {round_sql('12.0::DOUBLE * power((4.0::DOUBLE + s_suppkey % 9) / 8, 3) * power(1 + (s_suppkey % 5) / 10.0::DOUBLE, 0.65::DOUBLE)', 6)} AS rate FROM supplier"),
    "eta_stepwise": (eta_stepwise, f"SELECT event_id, {round_sql('100 / (8.0::DOUBLE * ((CASE WHEN event_id % 40 > 25 THEN 0.7::DOUBLE WHEN event_id % 40 > 15 THEN 0.85::DOUBLE ELSE 1 END) * (CASE WHEN value / 10 > 15 THEN 0.9::DOUBLE ELSE 1 END)))', 6)} AS hours FROM events"),
    "band_lookup": (band_lookup, "WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"({m}::DOUBLE, {t}::DOUBLE)" for m, t in _LENGTHS) + ") v(m, t)) SELECT p_partkey, (SELECT arg_min(t, m) FROM b WHERE p_size * 0.5::DOUBLE + 0.3::DOUBLE <= m AND p_size * 0.5::DOUBLE + 0.3::DOUBLE < 24) AS tonnage FROM part"),
    "effective_limit": (effective_limit, "WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN 60 WHEN 3 THEN 1e9 ELSE 0 END AS l, CASE c_nationkey % 4 WHEN 0 THEN 1e9 WHEN 1 THEN 60 WHEN 2 THEN 12 ELSE 0 END AS k FROM customer) SELECT c_custkey, CASE least(l, k) WHEN 0 THEN 'bahía' WHEN 1e9 THEN 'sin límite' ELSE least(l, k)::INT || ' MN' END AS limit_, CASE WHEN l < k THEN 'licence' WHEN k < l THEN 'class' ELSE 'both' END AS reason FROM c"),
    "alert_level": (alert_level, "SELECT event_id, CASE WHEN value / 3 >= 30 THEN 'alto' WHEN value / 3 >= 26 THEN 'medio' WHEN value / 3 >= 15 THEN 'bajo' ELSE 'normal' END AS level FROM events"),
    "worst_segment": (worst_segment, "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, ts, event_id) = 1"),
    "range_state": (range_state, "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size BETWEEN 10 AND 25 THEN 'good' WHEN p_size BETWEEN 5 AND 35 THEN 'fair' ELSE 'poor' END AS state FROM part"),
    "voyage_summary": (voyage_summary, f"WITH o AS (SELECT l_orderkey, sum(l_quantity) AS nm, sum(l_linenumber * 30.0::DOUBLE) AS m, count(*) AS legs FROM lineitem GROUP BY 1) SELECT l_orderkey, nm, {round_sql('m / 60', 4)} AS hours, {round_sql('nm / (m / 60)', 4)} AS sog, legs FROM o"),
    "segment_sog": (lambda s, d: segment_sog(s, d).drop("nm"), f"""WITH {_LEGS_SQL}, b AS (SELECT *, degrees(atan2(sin(radians(lng2 - lng)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lng2 - lng)))) AS b0, (s_suppkey % 7 - 3) * 0.8::DOUBLE AS dx, (s_suppkey % 11 - 5) * 0.6::DOUBLE AS dy FROM legs),
      k AS (SELECT *, sqrt(dx * dx + dy * dy) AS drift, radians((CASE WHEN b0 < 0 THEN b0 + 360 ELSE b0 END) - degrees(atan2(dx, dy))) AS alpha FROM b)
      SELECT route, s_suppkey, {round_sql('CASE WHEN 4 - power(drift * sin(alpha), 2) >= 0 THEN drift * cos(alpha) + sqrt(greatest(4 - power(drift * sin(alpha), 2), 0)) ELSE 0 END', 4)} AS sog, 4 - power(drift * sin(alpha), 2) < 0 AS alert FROM k"""),
}
QUERIES["navigation_totals"] = (navigation_totals, QUERIES["segment_sog"][1].replace("WITH ", "WITH q AS (WITH ", 1).replace("SELECT route, s_suppkey,", "SELECT route, s_suppkey, nm,") + f") SELECT route, {round_sql('sum(nm)', 2)} AS nm, {round_sql('coalesce(sum(CASE WHEN sog > 0.01 THEN nm / sog END), 0)', 2)} AS hours, bool_or(alert) AS alert FROM q GROUP BY 1")
