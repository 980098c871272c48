"""Queries on feeds: files read and written, fallbacks, windows of the map, tides' arguments, scopes of closures."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import scope, tide
from pelagos.functions.num import half_up
from pelagos.functions.text import normalize
from pelagos.operators.restrictions import read_once
from pelagos.plans.base import lat, lat_sql, lng, lng_sql, round_sql, table
from pelagos.sources import readers
from pelagos.sources.scratch import path

W_ = W.Window


def tide_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Equilibrium argument, node factor and node phase of thirteen constituents at every event."""
    e = table(spark, sf, "events").select("event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("seconds"))
    e = tide.arguments(e, "seconds")
    names = [*tide.CONSTITUENTS, *tide.COMPOUNDS]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"v_{n}").alias("v"), F.col(f"fa_{n}").alias("f"), F.col(f"ua_{n}").alias("u")) for n in names))).alias("x")
    return e.select("event_id", each).select("event_id", "x.name", half_up(F.col("x.v"), 6).alias("v"), half_up(F.col("x.f"), 6).alias("f"), half_up(F.col("x.u"), 6).alias("u"))


def _tide_sql() -> str:
    inner = "SELECT event_id, floor(epoch_us(ts) / 1000000.0::DOUBLE)::BIGINT AS seconds FROM events"
    for step in tide.steps("seconds"):
        inner = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM ({inner})"
    each = " UNION ALL ".join(f"SELECT event_id, '{n}' AS name, v_{n} AS v, fa_{n} AS f, ua_{n} AS u FROM a" for n in [*tide.CONSTITUENTS, *tide.COMPOUNDS])
    return f"WITH a AS ({inner}), e AS ({each}) SELECT event_id, name, {round_sql('v', 6)} AS v, {round_sql('f', 6)} AS f, {round_sql('u', 6)} AS u FROM e"


#: Closures as ports word them, and what they reach: kind, limit (a number, or "n" for the order's own), unit.
_CLOSURES = (
    ("Puerto cerrado para EE.MM. de {} AB dentro de la bahía", "limit", "n", "AB"), ("CERRADO PARA TODO TIPO DE NAVES por temporal", "total", None, None),
    ("Puerto cerrado para todo tipo de embarcaciones menores", "minors", None, None), ("Cerrado para naves mayores y menores", "total", None, None),
    ("SE CIERRA, CIERRE PARA NAVES MAYORES, y para menores de {} TRG", "unsummed", None, None), ("Cerrado para {} A/B. fuera", "limit", "n", "AB"),
    ("Cerrazón de niebla para naves menores", None, None, None), ("PURTO CERRADO para EE MM menores de {} AB; cierre para 12 AB", "limit", "m", "AB"),
    ("Restricción de naves menores", None, None, None), ("Prohibición de zarpe para embarcaciones menores y para 30 TRG", "minors", None, None),
)


def closure_scope(spark, sf):
    """Whom the text of a closure reaches: every kind of wording, with the order's own limit."""
    n = (F.col("o_custkey") % 90 + 1).cast("string")
    kinds = F.array(*(F.lit(t[0]) for t in _CLOSURES))
    text = F.replace(F.element_at(kinds, (F.col("o_orderkey") % len(_CLOSURES) + 1).cast("int")), F.lit("{}"), n)
    o = table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    read = read_once(o, "text", lambda t: t.withColumn("found", scope.parts(F.col("text"))).withColumn("s", scope.union(F.col("found"))))
    return read.select("o_orderkey", "s").select("o_orderkey", "s.kind", "s.limit", "s.unit")


def _closure_sql() -> str:
    limits = {"n": "o_custkey % 90 + 1", "m": "greatest(o_custkey % 90 + 1, 12)"}
    text = lambda x: "NULL" if x is None else f"'{x}'"
    case = lambda f: "CASE o_orderkey % " + str(len(_CLOSURES)) + " " + " ".join(f"WHEN {i} THEN {f(c)}" for i, c in enumerate(_CLOSURES)) + " END"
    return f"SELECT o_orderkey, {case(lambda c: text(c[1]))} AS kind, ({case(lambda c: limits.get(c[2], 'NULL'))})::BIGINT AS \"limit\", {case(lambda c: text(c[3]))} AS unit FROM orders"


# Three bands of tiles with their southern and northern edges.
_TILES = (("north", -36.0, -18.0), ("middle", -46.5, -35.5), ("south", -56.0, -46.0))


def tile_select(spark, sf):
    """The band that holds a place; on a seam the one whose edges are farther off."""
    c = table(spark, sf, "customer").select("c_custkey", lat("c_custkey").alias("lat"))
    margin = [(n, F.when(F.col("lat").between(a, b), F.least(F.lit(b) - F.col("lat"), F.col("lat") - F.lit(a)))) for n, a, b in _TILES]
    best = F.array_max(F.array(*(F.when(m.isNotNull(), F.struct(m.alias("m"), F.lit(-i).alias("i"), F.lit(n).alias("name"))) for i, (n, m) in enumerate(margin))))
    return c.select("c_custkey", best["name"].alias("tile"))


def lon_at_seam(spark, sf):
    """The longitude at which the line between two places crosses a parallel half way; the middle where both lie on it."""
    o = table(spark, sf, "orders").select("o_orderkey", lat("o_custkey").alias("y1"), lng("o_custkey").alias("x1"), lat("o_orderkey").alias("y2"), lng("o_orderkey").alias("x2"))
    seam = F.floor((F.col("y1") + F.col("y2")) / 2)
    t = (seam - F.col("y1")) / (F.col("y2") - F.col("y1"))
    x = F.when(F.abs(F.col("y2") - F.col("y1")) < 1e-9, (F.col("x1") + F.col("x2")) / 2).otherwise(F.col("x1") + t * (F.col("x2") - F.col("x1")))
    return o.select("o_orderkey", half_up(x, 6).alias("lng"))


def bbox_of_two(spark, sf):
    """The window around two places, with a margin of ten miles in degrees."""
    o = table(spark, sf, "orders").select("o_orderkey", lat("o_custkey").alias("y1"), lng("o_custkey").alias("x1"), lat("o_orderkey").alias("y2"), lng("o_orderkey").alias("x2"))
    m = 10.0 / 60.0
    return o.select("o_orderkey", half_up(F.least("x1", "x2") - m, 6).alias("west"), half_up(F.least("y1", "y2") - m, 6).alias("south"), half_up(F.greatest("x1", "x2") + m, 6).alias("east"), half_up(F.greatest("y1", "y2") + m, 6).alias("north"))


def path_sampling(spark, sf):
    """About a hundred points of each path, one in n / 100, and the last."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("k"))
    at = F.row_number().over(W_.partitionBy("l_suppkey").orderBy("l_orderkey")) - 1
    n = F.count("*").over(W_.partitionBy("l_suppkey"))
    p = li.select("l_suppkey", "l_orderkey", at.alias("i"), n.alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    return p.where((F.col("i") % step == 0) | (F.col("i") == F.col("n") - 1)).select("l_suppkey", "l_orderkey")


def measured_only(spark, sf):
    """Events with any measure at all."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.where(F.coalesce(F.col("value").cast("string"), F.col("k")).isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))


def without_source(spark, sf):
    """Places but those of one source, unless it is asked for."""
    wanted = F.lit(False)
    return table(spark, sf, "documents").where(wanted | (F.coalesce("source", F.lit("")) != "src0")).groupBy("source").agg(F.count("*").alias("n"))


def shape_with_fallbacks(spark, sf):
    """A row as the interface shows it: the first name that there is, blanks as none."""
    n = F.coalesce(F.nullif(F.trim(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))), F.lit("")), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", n.alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))


def optional_side(spark, sf):
    """Every nation beside one optional figure, which stays empty where there is none."""
    best = table(spark, sf, "supplier").where("s_acctbal > 1e9").agg(F.max("s_acctbal").alias("most")).where("most is not null")
    return table(spark, sf, "nation").select("n_nationkey").join(F.broadcast(best), F.lit(True), "left")


def features_concat(spark, sf):
    """Two arrays of features one after the other, those of the first source first."""
    g = lambda name, key, nation: table(spark, sf, name).groupBy(F.col(nation).alias("nation")).agg(F.array_sort(F.collect_list(key)).alias(name))
    both = g("supplier", "s_suppkey", "s_nationkey").join(g("customer", "c_custkey", "c_nationkey"), "nation", "full")
    all_ = F.concat(F.coalesce("supplier", F.array().cast("array<bigint>")), F.coalesce("customer", F.array().cast("array<bigint>")))
    return both.select("nation", F.size(all_).cast("bigint").alias("n"), F.element_at(all_, 1).alias("first"), F.element_at(all_, -1).alias("last"))


def independent_layers(spark, sf):
    """Layers of a map counted apart; a layer that cannot be read is empty and says so."""
    out = None
    for name in ("supplier", "customer", "part", "charts"):
        try:
            one = table(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n", F.lit("ok").alias("state"))
        except AnalysisException:
            one = spark.range(1).select(F.lit(name).alias("layer"), F.lit(None).cast("bigint").alias("n"), F.lit("missing").alias("state"))
        out = one if out is None else out.union(one)
    return out


def cascading_source(spark, sf):
    """Coast pieces from the first of several sources that can be read: one is missing, one is empty, the third has rows."""
    read = lambda name, rule="true": lambda: table(spark, sf, name).where(rule)
    name, rows, failed = readers.first_readable([("charts", read("charts")), ("orders", read("orders", "o_orderkey < 0")), ("supplier", read("supplier")), ("customer", read("customer"))])
    return rows.select(F.col("s_suppkey").alias("id"), F.lit(name).alias("source"), F.lit(len(failed)).cast("bigint").alias("passed_over"))


def datum_label(spark, sf):
    """The datum that a text declares; local ones and those not known are rejected."""
    kinds = F.array(*map(F.lit, ("Coordenadas Geográficas (WGS-84)", "Datum: SAD 69", "Dátum (Local)", "Datum SIRGAS (WGS 84)", "sin etiqueta", "Datum: PSAD-56")))
    s = table(spark, sf, "supplier").select("s_suppkey", F.upper(normalize(F.element_at(kinds, (F.col("s_suppkey") % 6 + 1).cast("int")))).alias("t"))
    label = F.regexp_extract("t", r"(?:COORDENADAS GEOGRAFICAS \(|DATUM:? ?\(?)\s*(WGS[ -]?84|SAD[ -]?69|SIRGAS|LOCAL|PSAD[ -]?56)", 1)
    plain = F.regexp_replace(label, "[ -]", "")
    state = F.when(plain == "", "assumed").when(plain.isin("WGS84", "SIRGAS"), "as it is").when(plain == "SAD69", "shift").otherwise("rejected")
    return s.select("s_suppkey", F.when(plain == "SIRGAS", "WGS84").otherwise(F.nullif(plain, F.lit(""))).alias("datum"), state.alias("state"))


def grid_extents(spark, sf):
    """Origin, columns and rows of a grid of 50-metre cells around each nation's customers, edges on whole cells."""
    m = 111_320.0
    c = table(spark, sf, "customer").select("c_nationkey", (lng("c_custkey") * m).alias("x"), (lat("c_custkey") * m).alias("y"))
    g = c.groupBy("c_nationkey").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    g = g.withColumns({"ox": F.floor(F.col("x1") / 50) * 50, "oy": F.ceil(F.col("y2") / 50) * 50})
    return g.select("c_nationkey", "ox", "oy", F.ceil((F.col("x2") - F.col("ox")) / 50).alias("cols"), F.ceil((F.col("oy") - F.col("y1")) / 50).alias("rows"))


def literal_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogues of fifty suppliers each, written out in source code: their entries, and what is wrong with those that do not read."""
    k = F.col("s_suppkey").cast("bigint")
    place = F.concat(F.lit("lat: "), lat("s_suppkey").cast("string"), F.when(k % 7 == 0, ", lon: ").otherwise(", lng: "), lng("s_suppkey").cast("string"))
    entry = F.concat(F.lit("  "), k.cast("string"), F.lit(": { "), place, F.lit(", nombre: '"), F.col("s_name"), F.lit("' },\n"))
    lines = table(spark, sf, "supplier").groupBy(F.floor(k / 50).alias("file")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("lines"))
    sources = lines.select("file", F.concat(F.lit("const BAYS = {\n"), "lines", F.when(F.col("file") % 5 == 1, "").otherwise("};\n")).alias("text"))
    return readers.literal_entries(sources, "BAYS")


def hour_index(spark, sf):
    """Of a user's readings of a day the one of the current hour, or the last that there is; the hour is that of the day's last reading."""
    day = W_.partitionBy("user_id", "day")
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value", F.hour("ts").alias("now"))
    e = e.withColumns({"i": F.row_number().over(day.orderBy("event_id")) - 1, "n": F.count("*").over(day), "at": F.max(F.struct("event_id", "now")).over(day)["now"]})
    return e.where(F.col("i") == F.least(F.col("at"), F.col("n") - 1)).select("user_id", "day", half_up(F.col("value"), 6).alias("value"))


def override_with_fallback(spark, sf):
    """South of a parallel a second source's current replaces the first's where it has one; which was used is told."""
    s = table(spark, sf, "supplier").select("s_suppkey", lat("s_suppkey").alias("lat"), (F.col("s_acctbal") / 1000).alias("u"))
    other = table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 2000).alias("u2"))
    j = s.join(other, "s_suppkey", "left").withColumn("south", F.col("lat") < -41.0)
    used = F.col("south") & F.col("u2").isNotNull()
    return j.select("s_suppkey", F.when(used, half_up(F.col("u2"), 2)).otherwise(half_up(F.col("u"), 2)).alias("u"), F.when(used, "second").when(F.col("south"), "fallback").otherwise("first").alias("source"))


def flat_array_points(spark, sf):
    """Points of flat coordinate arrays, as coast pieces come."""
    flat = F.flatten(F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 4).cast("int")), lambda i: F.array(F.lit(-70.0) - i, F.lit(-30.0) - i * 2))) 
    s = table(spark, sf, "supplier").select("s_suppkey", F.explode(readers.points_of(F.concat(flat, F.array(F.lit(1.0))))).alias("p"))
    return s.select("s_suppkey", "p.lng", "p.lat")


def csv_units_scan(spark, sf):
    """A CSV with names and units before its rows, written and read; longitudes of 0 to 360 degrees become west ones."""
    s = table(spark, sf, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 360).cast("string"), F.round("s_acctbal", 2).cast("string")).alias("value"))
    head = spark.createDataFrame([("id,lon,level",), ("count,degrees_east,mm",)], "value string")
    to = path(spark, "csv-units")
    head.union(s).write.text(to)
    read = readers.csv_with_units(spark, to, "id bigint, lon double, level double", "count,degrees_east,mm")
    return read.select("id", readers.west(F.col("lon")).alias("lon"), "level")


def quoted_csv_scan(spark, sf):
    """Texts with quotes, commas and line ends, written as quoted CSV behind a byte order mark and read again."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    b = table(spark, sf, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(","), q(F.concat("text", F.lit(' "q", x')))).alias("value"))
    head = spark.createDataFrame([("\ufeffitem_id,text",)], "value string")
    to = path(spark, "csv-quoted")
    head.union(b).write.text(to)
    read = readers.quoted_csv(spark, to, "item_id string, text string")
    return read.select(F.col("item_id").cast("bigint").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


def json_feed_scan(spark, sf):
    """The feed's JSON, sets of records in one document, written and read again."""
    rec = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(rec).alias("r"))
    to = path(spark, "json-feed")
    o.select(F.to_json(F.struct(F.array("r").alias("recordsets"))).alias("value")).write.text(to)
    return readers.json_records(spark, to, "struct<id:bigint,kind:string>").select("id", "kind")


def geojson_features(spark, sf):
    """Each nation's customers as a GeoJSON feature, whose geometry and properties are read back."""
    c = table(spark, sf, "customer").select("c_nationkey", F.array(half_up(lng("c_custkey"), 4), half_up(lat("c_custkey"), 4)).alias("p"), "c_custkey")
    g = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "p"))).alias("x"))
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPoint").alias("type"), F.transform("x", lambda e: e["p"]).alias("coordinates")).alias("geometry"), F.struct(F.col("c_nationkey").alias("nation")).alias("properties")))
    back = g.select(F.from_json(f, "type string, geometry struct<type:string,coordinates:array<array<double>>>, properties struct<nation:bigint>").alias("f"))
    return back.select(F.col("f.properties.nation").alias("nation"), F.size("f.geometry.coordinates").cast("bigint").alias("n"), F.element_at("f.geometry.coordinates", 1)[0].alias("lng"))


def tsv_lines(spark, sf):
    """A work sheet's lines: tabs between, tabs and line ends inside as blanks."""
    d = table(spark, sf, "benchmark")
    return d.select("item_id", F.concat_ws("\t", F.col("item_id").cast("string"), F.regexp_replace("text", r"[\t\r\n]", " ")).alias("line"))


_TWO = f"o AS (SELECT o_orderkey, {lat_sql('o_custkey')} AS y1, {lng_sql('o_custkey')} AS x1, {lat_sql('o_orderkey')} AS y2, {lng_sql('o_orderkey')} AS x2 FROM orders)"
QUERIES = {
    "literal_catalogue": (literal_catalogue, f"""WITH s AS (SELECT s_suppkey::BIGINT AS key, s_suppkey::BIGINT // 50 AS file, s_name, {lat_sql('s_suppkey')} AS lat, {lng_sql('s_suppkey')} AS lng FROM supplier)
      SELECT file, key, CASE WHEN key % 7 <> 0 THEN lat END AS lat, CASE WHEN key % 7 <> 0 THEN lng END AS lng, CASE WHEN key % 7 <> 0 THEN s_name END AS name, CASE WHEN key % 7 = 0 THEN 'unreadable' END AS problem FROM s WHERE file % 5 <> 1
      UNION ALL SELECT DISTINCT file, NULL, NULL, NULL, NULL, 'not closed' FROM s WHERE file % 5 = 1"""),
    "tide_arguments": (tide_arguments, _tide_sql()),
    "closure_scope": (closure_scope, _closure_sql()),
    "tile_select": (tile_select, f"WITH c AS (SELECT c_custkey, {lat_sql('c_custkey')} AS lat FROM customer), t(name, a, b, i) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {i})" for i, (n, a, b) in enumerate(_TILES)) + "), k AS (SELECT c_custkey, name, row_number() OVER (PARTITION BY c_custkey ORDER BY least(b - lat, lat - a) DESC, i) AS k FROM c JOIN t ON lat BETWEEN a AND b) SELECT c.c_custkey, k.name AS tile FROM c LEFT JOIN k ON c.c_custkey = k.c_custkey AND k.k = 1"),
    "lon_at_seam": (lon_at_seam, f"WITH {_TWO} SELECT o_orderkey, {round_sql('CASE WHEN abs(y2 - y1) < 1e-9 THEN (x1 + x2) / 2 ELSE x1 + (floor((y1 + y2) / 2) - y1) / (y2 - y1) * (x2 - x1) END', 6)} AS lng FROM o"),
    "bbox_of_two": (bbox_of_two, f"WITH {_TWO} SELECT o_orderkey, {round_sql('least(x1, x2) - 10.0::DOUBLE / 60', 6)} AS west, {round_sql('least(y1, y2) - 10.0::DOUBLE / 60', 6)} AS south, {round_sql('greatest(x1, x2) + 10.0::DOUBLE / 60', 6)} AS east, {round_sql('greatest(y1, y2) + 10.0::DOUBLE / 60', 6)} AS north FROM o"),
    "path_sampling": (path_sampling, "WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM d) SELECT l_suppkey, l_orderkey FROM p WHERE i % greatest(1, n // 100) = 0 OR i = n - 1"),
    "measured_only": (measured_only, "SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL OR json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1"),
    "without_source": (without_source, "SELECT source, count(*) AS n FROM documents WHERE coalesce(source, '') <> 'src0' GROUP BY 1"),
    "shape_with_fallbacks": (shape_with_fallbacks, "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN nullif(trim(c_name), '') END, c_mktsegment) AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer"),
    "optional_side": (optional_side, "SELECT n_nationkey, (SELECT max(s_acctbal) FROM supplier WHERE s_acctbal > 1e9) AS most FROM nation"),
    "features_concat": (features_concat, "WITH a AS (SELECT s_nationkey AS nation, 0 AS src, s_suppkey AS id FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer) SELECT nation, count(*) AS n, arg_min(id, (src, id)) AS first, arg_max(id, (src, id)) AS last FROM a GROUP BY 1"),
    "independent_layers": (independent_layers, "SELECT 'supplier' AS layer, (SELECT count(*) FROM supplier) AS n, 'ok' AS state UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 'ok' UNION ALL SELECT 'part', (SELECT count(*) FROM part), 'ok' UNION ALL SELECT 'charts', NULL, 'missing'"),
    "datum_label": (datum_label, "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'WGS84' WHEN 1 THEN 'SAD69' WHEN 2 THEN 'LOCAL' WHEN 3 THEN 'WGS84' WHEN 5 THEN 'PSAD56' END AS datum, CASE s_suppkey % 6 WHEN 0 THEN 'as it is' WHEN 1 THEN 'shift' WHEN 3 THEN 'as it is' WHEN 4 THEN 'assumed' ELSE 'rejected' END AS state FROM supplier"),
    "grid_extents": (grid_extents, f"WITH c AS (SELECT c_nationkey, {lng_sql('c_custkey')} * 111320.0::DOUBLE AS x, {lat_sql('c_custkey')} * 111320.0::DOUBLE AS y FROM customer), g AS (SELECT c_nationkey, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM c GROUP BY 1), h AS (SELECT *, (floor(x1 / 50) * 50)::BIGINT AS ox, (ceil(y2 / 50) * 50)::BIGINT AS oy FROM g) SELECT c_nationkey, ox, oy, ceil((x2 - ox) / 50)::BIGINT AS cols, ceil((oy - y1) / 50)::BIGINT AS rows FROM h"),
    "cascading_source": (cascading_source, "SELECT s_suppkey AS id, 'supplier' AS source, 2::BIGINT AS passed_over FROM supplier"),
    "hour_index": (hour_index, f"WITH e AS (SELECT *, ts::DATE AS day, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id, ts::DATE) AS n, last_value(hour(ts)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY event_id)) SELECT user_id, day, {round_sql('value', 6)} AS value FROM e WHERE i = least(now, n - 1)"),
    "override_with_fallback": (override_with_fallback, f"WITH s AS (SELECT s_suppkey, {lat_sql('s_suppkey')} < -41 AS south, s_acctbal / 1000 AS u, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 2000 END AS u2 FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey) SELECT s_suppkey, CASE WHEN south AND u2 IS NOT NULL THEN {round_sql('u2', 2)} ELSE {round_sql('u', 2)} END AS u, CASE WHEN south AND u2 IS NOT NULL THEN 'second' WHEN south THEN 'fallback' ELSE 'first' END AS source FROM s"),
    "flat_array_points": (flat_array_points, "SELECT s_suppkey, -70.0::DOUBLE - i AS lng, -30.0::DOUBLE - i * 2 AS lat FROM supplier, range(4) r(i) WHERE i <= s_suppkey % 4"),
    "csv_units_scan": (csv_units_scan, "SELECT s_suppkey AS id, (CASE WHEN s_suppkey % 360 > 180 THEN s_suppkey % 360 - 360 ELSE s_suppkey % 360 END)::DOUBLE AS lon, round(s_acctbal, 2) AS level FROM supplier"),
    "quoted_csv_scan": (quoted_csv_scan, "SELECT item_id, md5(text || ' \"q\", x') AS digest FROM benchmark"),
    "json_feed_scan": (json_feed_scan, "SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders"),
    "geojson_features": (geojson_features, f"SELECT c_nationkey::BIGINT AS nation, count(*) AS n, arg_min({round_sql(lng_sql('c_custkey'), 4)}, c_custkey) AS lng FROM customer GROUP BY 1"),
    "tsv_lines": (tsv_lines, r"SELECT item_id, item_id || chr(9) || regexp_replace(text, '[\t\r\n]', ' ', 'g') AS line FROM benchmark"),
}
