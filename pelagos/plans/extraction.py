"""Queries that read fields from pages, documents and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions.num import half_up
from pelagos.plans.base import feed, round_sql, table
from pelagos.plans.places import _GRID_SQL, _grid
from pelagos.plans.restrictions import NORM_SQL
from pelagos.operators import restrictions as R
from pelagos.operators.ranking import ranked

W_ = W.Window


def html_table_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Links of each page's menu, in order."""
    p = table(spark, sf, "pages").select("page_id", F.posexplode(F.expr(r"regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)")).alias("k", "href"))
    return p.select("page_id", F.col("k").cast("bigint").alias("k"), "href")


def keyword_page_index(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.lower("html").alias("t"))
    words = F.array(*(F.struct(F.lit(w).alias("word"), F.col("t").contains(w).alias("hit")) for w in ("footer", "tion", "sch", "que")))
    hits = p.select("page_id", F.explode(words).alias("x")).where("x.hit").select("page_id", F.col("x.word").alias("word"))
    return hits.groupBy("word").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"), F.sum("page_id").alias("ids"))


def dms_to_decimal(spark, sf):
    """Degrees, minutes and seconds with a hemisphere to signed degrees; impossible ones are null."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    raw = F.concat((k % 95).cast("string"), F.lit("°"), (k * 7 % 63).cast("string"), F.lit("'"), F.format_string("%.1f", (k * 13 % 600) / F.lit(10.0)), F.lit('"'), F.when(k % 2 == 0, "S").otherwise("N"))
    c = c.select("c_custkey", raw.alias("raw"))
    part = lambda i, t: F.regexp_extract("raw", r"^(\d+)°(\d+)'([\d.]+)\"([NS])$", i).cast(t)
    c = c.withColumns({"d": part(1, "int"), "m": part(2, "int"), "s": part(3, "double"), "h": part(4, "string")})
    ok = (F.col("d") <= 90) & (F.col("m") < 60) & (F.col("s") < 60)
    return c.select("c_custkey", F.when(ok, half_up((F.col("d") + F.col("m") / 60.0 + F.col("s") / 3600.0) * F.when(F.col("h") == "S", -1).otherwise(1), 6)).alias("deg"))


def clause_segmentation(spark, sf):
    """Lines of a document that are headings of their own, and how long the clause behind each is, 700 characters at most."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\.\n")).alias("k", "clause"))
    return d.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.max(F.least(F.length("clause"), F.lit(700))).cast("bigint").alias("longest"))


def quantity_extract(spark, sf):
    """Widths in miles or cables, to metres."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("ancho de "), (F.col("o_custkey") % 9 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " cables").otherwise(" millas"), F.when(F.col("o_orderkey") % 3 == 0, " y profundidad de 12 a 30 m").otherwise("")).alias("t"))
    n = F.regexp_extract("t", r"ancho de (\d+) (cables|millas)", 1).cast("double")
    unit = F.regexp_extract("t", r"ancho de (\d+) (cables|millas)", 2)
    return o.select("o_orderkey", (n * F.when(unit == "cables", 185.2).otherwise(1852.0)).alias("width_m"), F.nullif(F.regexp_extract("t", r"profundidad de (\d+) a (\d+) m", 1), F.lit("")).cast("bigint").alias("depth_m"))


def hazard_type(spark, sf):
    p = table(spark, sf, "part")
    t = F.lower("p_type")
    kind = F.when(t.rlike(r"^small.*(tin|steel)"), "rock").when(t.rlike("^large"), "island").when(t.rlike("brass|copper"), "bank").otherwise("unspecified")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def dehyphenate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("th"), F.lit("t-\nh")), "-\n", ""), r"[ \t]+", " ").alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"))


def unique_match_or_error(spark, sf):
    """The one title of a page; more or none is a state of its own."""
    p = table(spark, sf, "pages").select("page_id", F.expr("regexp_extract_all(html, '<title>([^<]*)</title>', 1)").alias("m"))
    return p.select("page_id", F.when(F.size("m") == 1, F.element_at("m", 1)).alias("title"), F.when(F.size("m") == 1, "one").when(F.size("m") == 0, "none").otherwise("several").alias("state"))


def carry_forward_header(spark, sf):
    """Turns carry the last heading of their conversation: the last turn of the user."""
    w = W_.partitionBy("conv_id").orderBy("turn").rowsBetween(W_.unboundedPreceding, 0)
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("heading"))


def first_occurrence(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    f = d.groupBy("key").agg(F.min("doc_id").alias("first"))
    return d.join(f, "key").where("first < doc_id").select("doc_id", F.col("first").alias("duplicate_of"))


def keyword_in_context(spark, sf):
    """Four words on either side of a keyword."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("w"))
    d = d.select("doc_id", "w", F.posexplode("w").alias("k", "x")).where("x = 'worthless'")
    around = F.expr("array_join(slice(w, greatest(k - 3, 1), k + 5 - greatest(k - 3, 1) + 1), ' ')")
    return d.select("doc_id", F.col("k").cast("bigint").alias("k"), F.md5(around.cast("binary")).alias("context"))


def clean_name(spark, sf):
    d = table(spark, sf, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"[\r\n\t]", " ")).alias("t"))
    return d.select("item_id", F.md5(F.col("t").cast("binary")).alias("digest"))


def coordinate_pairs(spark, sf):
    """Coordinates in a text, paired in order: latitude, then longitude."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("entre 41°"), (F.col("o_custkey") % 60).cast("string"), F.lit("'S y 72°"), (F.col("o_custkey") * 3 % 60).cast("string"), F.lit("'W, 42°0'S")).alias("t"))
    m = o.select("o_orderkey", F.posexplode(F.expr(r"regexp_extract_all(t, '([0-9]+°[0-9]+\'[NSWE])', 1)")).alias("k", "x"))
    nxt = F.lead("x").over(W_.partitionBy("o_orderkey").orderBy("k"))
    return m.withColumn("n", nxt).where(F.col("x").rlike("[NS]$") & F.col("n").rlike("[WE]$")).select("o_orderkey", F.col("x").alias("lat"), F.col("n").alias("lng"))


def scope_union(spark, sf):
    """The widest scope of each bay's texts: all before majors before minors under a limit (the highest) before unread."""
    n = R.normalized(feed(spark, sf))
    rank = F.when(F.col("total"), 4).when(F.col("majors"), 3).when(F.col("minors") & F.col("outside").isNull(), 2).when(F.col("outside").isNotNull(), 1).otherwise(0)
    g = n.groupBy("bay").agg(F.max(rank).alias("r"), F.max("outside").alias("limit_"))
    return g.select("bay", F.element_at(F.array(*map(F.lit, ("no_legible", "umbral", "menores", "mayores", "total"))), F.col("r") + 1).alias("scope"), F.when(F.col("r") == 1, F.col("limit_")).alias("limit_"))


def latitude_band_claim(spark, sf):
    """Zones claim places by their band of latitude; a place has at most one."""
    z = table(spark, sf, "region").select("r_name", (F.lit(-18.0) - F.col("r_regionkey") * 8.0).alias("top"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.lit(-18.0) - (F.col("s_suppkey") * 7919 % 3800) / F.lit(100.0)).alias("lat"))
    near = s.join(z, (F.col("lat") <= F.col("top")) & (F.col("lat") > F.col("top") - 8.0))
    return near.select("s_suppkey", "r_name")


def claim_precedence(spark, sf):
    """Zone before published scope before gap; a single captaincy is named."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("zones"), F.count_if(F.col("c_acctbal") < 0).alias("scopes"), F.min("c_mktsegment").alias("one"))
    via = F.when(F.col("zones") == 1, "zone").when(F.col("scopes") > 0, "scope").otherwise("gap")
    return c.select("c_nationkey", via.alias("via"), F.when(F.col("zones") == 1, F.concat(F.lit("Capitanía "), "one")).otherwise("sin nombre").alias("notice"))


def adjudication_priority(spark, sf):
    """The place of every order by five keys."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    keys = [F.desc("o_orderstatus"), F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey")]
    return ranked(o, keys, "priority").select("o_orderkey", "priority")


def path_metrics(spark, sf):
    q = F.col("l_quantity")
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_quantity").alias("most"), F.count_if(q < 10).alias("narrow"), F.count_if(q.between(10, 30)).alias("middle"), half_up(F.count_if(q > 30) / F.count("*"), 6).alias("open_share"))
    return li


def underkeel_warnings(spark, sf):
    """Passes shallower than draught and margin; the margin is half a metre or a tenth of the draught."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 60 / F.lit(10.0)).alias("sounding")).agg(F.count("*").alias("passes"))
    v = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (0.8 + F.col("c_custkey") % 31 / F.lit(10.0)).alias("draught"))
    j = v.join(s, F.col("c_nationkey") == F.col("s_nationkey"))
    return j.where(F.col("sounding") < F.col("draught") + F.greatest(F.lit(0.5), 0.1 * F.col("draught"))).groupBy("c_custkey").agg(F.sum("passes").alias("warnings"))


def ship_physics(spark, sf):
    s = table(spark, sf, "supplier")
    length, beam, draught = 6.0 + F.col("s_suppkey") % 18, 2.0 + F.col("s_suppkey") % 5, 0.8 + F.col("s_suppkey") % 7 / F.lit(10.0)
    cb = F.when(F.col("s_nationkey") % 3 == 0, 0.45).when(F.col("s_nationkey") % 3 == 1, 0.55).otherwise(0.65)
    d = length * beam * draught * cb * 1.025
    return s.select("s_suppkey", half_up(d, 4).alias("displacement"), (F.abs(d - 3.2 * (F.col("s_suppkey") % 40)) <= 0.15 * 3.2 * (F.col("s_suppkey") % 40)).alias("plausible"))


def autonomy(spark, sf):
    s = table(spark, sf, "supplier")
    rate = 4.0 + F.col("s_suppkey") % 13
    return s.select("s_suppkey", half_up((200.0 + F.col("s_suppkey") % 300) * 0.9 / rate, 4).alias("hours"), half_up((200.0 + F.col("s_suppkey") % 300) * 0.9 / rate * 7.5, 4).alias("nm"))


def licence_validation(spark, sf):
    c = table(spark, sf, "customer").withColumn("l", F.col("c_custkey") % 5)
    e = F.array_compact(F.array(F.when(F.col("l") == 4, "licence"), F.when((F.col("l") < 2) & (F.col("c_acctbal") > 5000), "beyond licence"), F.when(F.col("c_nationkey") > 20, "class")))
    return c.select("c_custkey", F.array_join(e, "; ").alias("errors"), F.when(F.size(e) == 0, "Q").when(F.size(e) == 1, "U").otherwise("UV").alias("verdict"))


def mercator_inverse(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.lit(-8000000.0) + F.col("s_suppkey") * 1000).alias("x"), (F.lit(-4000000.0) - F.col("s_suppkey") * 2000).alias("y"))
    r = 6378137.0
    return s.select("s_suppkey", half_up(F.degrees(F.col("x") / r), 6).alias("lng"), half_up(F.degrees(2 * F.atan(F.exp(F.col("y") / r)) - F.lit(3.141592653589793) / 2), 6).alias("lat"))


def monotone_chain(spark, sf):
    """Routes whose latitudes go one way only."""
    w = W_.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 7919 % 3800).alias("y"))
    s = s.withColumn("d", F.col("y") - F.lag("y").over(w)).where("d is not null")
    return s.groupBy("s_nationkey").agg(F.bool_and(F.col("d") > 0).alias("down"), F.bool_and(F.col("d") < 0).alias("up"), F.count("*").alias("steps"))


def distinct_vertices(spark, sf):
    c = table(spark, sf, "customer").select(half_up((F.col("c_custkey") * 7919 % 3800) / F.lit(100.0), 0).alias("y"), half_up((F.col("c_custkey") * 104729 % 1000) / F.lit(100.0), 0).alias("x"))
    return c.distinct().groupBy("y").agg(F.count("*").alias("n"))


def cost_lut(spark, sf):
    """The cost of every cell by its packed value: relaxed bit, confidence and distance."""
    g = _grid(spark, sf)
    v = F.shiftleft(F.col("r") % 2, 15).bitwiseOR(F.shiftleft(F.col("c") % 4, 13)).bitwiseOR(F.least((F.col("v") - 3900) * 7, F.lit(8191)))
    g = g.where("v >= 3900").select("r", "c", v.alias("packed"))
    d = F.col("packed").bitwiseAND(8191) * 10.0
    base = F.when(d < 50, 1.6 - 0.6 * d / 50).when(d <= 9260, 1.0).otherwise(F.least(1.0 + 2.0 * (d - 9260) / 9260, F.lit(12.0)))
    conf = F.element_at(F.array(F.lit(1.19), F.lit(1.1), F.lit(1.0), F.lit(0.8)), (F.shiftright("packed", 13).bitwiseAND(3) + 1).cast("int"))
    return g.select("r", "c", half_up(base * conf, 6).alias("cost"))


_LAT = "(-18.0::DOUBLE - ((s_suppkey * 7919) % 3800) / 100.0::DOUBLE)"
QUERIES = {
    "html_table_extract": (html_table_extract, """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS l FROM pages) SELECT page_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS href FROM l"""),
    "keyword_page_index": (keyword_page_index, "SELECT word, count(*) AS pages, min(page_id) AS first, sum(page_id)::BIGINT AS ids FROM pages, (VALUES ('footer'), ('tion'), ('sch'), ('que')) v(word) WHERE contains(lower(html), word) GROUP BY 1"),
    "dms_to_decimal": (dms_to_decimal, f"WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS c_custkey, CASE WHEN k % 95 <= 90 AND k * 7 % 63 < 60 THEN {round_sql('(k % 95 + (k * 7 % 63) / 60.0::DOUBLE + ((k * 13 % 600) / 10.0::DOUBLE) / 3600.0::DOUBLE) * CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END', 6)} END AS deg FROM c"),
    "clause_segmentation": (clause_segmentation, "WITH c AS (SELECT doc_id, unnest(string_split(text, '.' || chr(10))) AS c FROM documents) SELECT doc_id, count(*) AS clauses, max(least(length(c), 700))::BIGINT AS longest FROM c GROUP BY 1"),
    "quantity_extract": (quantity_extract, "SELECT o_orderkey, (o_custkey % 9 + 1) * CASE WHEN o_orderkey % 2 = 0 THEN 185.2::DOUBLE ELSE 1852.0::DOUBLE END AS width_m, CASE WHEN o_orderkey % 3 = 0 THEN 12::BIGINT END AS depth_m FROM orders"),
    "hazard_type": (hazard_type, "SELECT CASE WHEN regexp_matches(lower(p_type), '^small.*(tin|steel)') THEN 'rock' WHEN lower(p_type) LIKE 'large%' THEN 'island' WHEN regexp_matches(lower(p_type), 'brass|copper') THEN 'bank' ELSE 'unspecified' END AS kind, count(*) AS n FROM part GROUP BY 1"),
    "dehyphenate": (dehyphenate, r"SELECT doc_id, md5(regexp_replace(text, '[ \t]+', ' ', 'g')) AS digest FROM documents"),
    "unique_match_or_error": (unique_match_or_error, "WITH m AS (SELECT page_id, regexp_extract_all(html, '<title>([^<]*)</title>', 1) AS m FROM pages) SELECT page_id, CASE WHEN len(m) = 1 THEN m[1] END AS title, CASE len(m) WHEN 1 THEN 'one' WHEN 0 THEN 'none' ELSE 'several' END AS state FROM m"),
    "carry_forward_header": (carry_forward_header, "WITH c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM c"),
    "first_occurrence": (first_occurrence, "WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) SELECT doc_id, f AS duplicate_of FROM f WHERE f < doc_id"),
    "keyword_in_context": (keyword_in_context, "WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), k AS (SELECT doc_id, w, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d) SELECT doc_id, k - 1 AS k, md5(array_to_string(w[greatest(k - 4, 1):k + 4], ' ')) AS context FROM k WHERE x = 'worthless'"),
    "clean_name": (clean_name, r"SELECT item_id, md5(trim(regexp_replace(text, '[\r\n\t]', ' ', 'g'))) AS digest FROM benchmark"),
    "coordinate_pairs": (coordinate_pairs, "SELECT o_orderkey, '41°' || (o_custkey % 60) || '''S' AS lat, '72°' || (o_custkey * 3 % 60) || '''W' AS lng FROM orders"),
    "scope_union": (scope_union, f"WITH {NORM_SQL}, g AS (SELECT bay, max(CASE WHEN total THEN 4 WHEN majors THEN 3 WHEN minors AND outside IS NULL THEN 2 WHEN outside IS NOT NULL THEN 1 ELSE 0 END) AS r, max(outside) AS l FROM norm GROUP BY 1) SELECT bay, ['no_legible', 'umbral', 'menores', 'mayores', 'total'][r + 1] AS scope, CASE WHEN r = 1 THEN l END AS limit_ FROM g"),
    "latitude_band_claim": (latitude_band_claim, f"SELECT s_suppkey, r_name FROM supplier JOIN region ON {_LAT} <= -18 - r_regionkey * 8 AND {_LAT} > -26 - r_regionkey * 8"),
    "claim_precedence": (claim_precedence, "SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN 'zone' WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 'scope' ELSE 'gap' END AS via, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN 'Capitanía ' || min(c_mktsegment) ELSE 'sin nombre' END AS notice FROM customer GROUP BY 1"),
    "adjudication_priority": (adjudication_priority, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderpriority, o_totalprice DESC, o_orderdate, o_orderkey) AS priority FROM orders"),
    "path_metrics": (path_metrics, f"SELECT l_suppkey, max(l_quantity) AS most, count(*) FILTER (WHERE l_quantity < 10) AS narrow, count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 30) AS middle, {round_sql('(count(*) FILTER (WHERE l_quantity > 30))::DOUBLE / count(*)', 6)} AS open_share FROM lineitem GROUP BY 1"),
    "underkeel_warnings": (underkeel_warnings, "WITH v AS (SELECT c_custkey, c_nationkey, 0.8::DOUBLE + (c_custkey % 31) / 10.0::DOUBLE AS d FROM customer) SELECT c_custkey, count(*) AS warnings FROM v JOIN supplier ON c_nationkey = s_nationkey WHERE (s_suppkey % 60) / 10.0::DOUBLE < d + greatest(0.5::DOUBLE, 0.1::DOUBLE * d) GROUP BY 1"),
    "ship_physics": (ship_physics, f"WITH s AS (SELECT s_suppkey, (6.0::DOUBLE + s_suppkey % 18) * (2.0::DOUBLE + s_suppkey % 5) * (0.8::DOUBLE + (s_suppkey % 7) / 10.0::DOUBLE) * CASE s_nationkey % 3 WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 0.55::DOUBLE ELSE 0.65::DOUBLE END * 1.025::DOUBLE AS d FROM supplier) SELECT s_suppkey, {round_sql('d', 4)} AS displacement, abs(d - 3.2::DOUBLE * (s_suppkey % 40)) <= 0.15::DOUBLE * 3.2::DOUBLE * (s_suppkey % 40) AS plausible FROM s"),
    "autonomy": (autonomy, f"SELECT s_suppkey, {round_sql('(200.0::DOUBLE + s_suppkey % 300) * 0.9::DOUBLE / (4.0::DOUBLE + s_suppkey % 13)', 4)} AS hours, {round_sql('(200.0::DOUBLE + s_suppkey % 300) * 0.9::DOUBLE / (4.0::DOUBLE + s_suppkey % 13) * 7.5::DOUBLE', 4)} AS nm FROM supplier"),
    "licence_validation": (licence_validation, "WITH e AS (SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 5 = 4 THEN 'licence' END, CASE WHEN c_custkey % 5 < 2 AND c_acctbal > 5000 THEN 'beyond licence' END, CASE WHEN c_nationkey > 20 THEN 'class' END) AS errors FROM customer) SELECT c_custkey, errors, CASE WHEN errors = '' THEN 'Q' WHEN NOT contains(errors, ';') THEN 'U' ELSE 'UV' END AS verdict FROM e"),
    "mercator_inverse": (mercator_inverse, f"SELECT s_suppkey, {round_sql('degrees((-8000000.0::DOUBLE + s_suppkey * 1000) / 6378137.0::DOUBLE)', 6)} AS lng, {round_sql('degrees(2 * atan(exp((-4000000.0::DOUBLE - s_suppkey * 2000) / 6378137.0::DOUBLE)) - pi() / 2)', 6)} AS lat FROM supplier"),
    "monotone_chain": (monotone_chain, "WITH d AS (SELECT s_nationkey, s_suppkey * 7919 % 3800 - lag(s_suppkey * 7919 % 3800) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS d FROM supplier) SELECT s_nationkey, bool_and(d > 0) AS down, bool_and(d < 0) AS up, count(*) AS steps FROM d WHERE d IS NOT NULL GROUP BY 1"),
    "distinct_vertices": (distinct_vertices, "WITH v AS (SELECT DISTINCT floor((c_custkey * 7919 % 3800) / 100.0::DOUBLE + 0.5) AS y, floor((c_custkey * 104729 % 1000) / 100.0::DOUBLE + 0.5) AS x FROM customer) SELECT y, count(*) AS n FROM v GROUP BY 1"),
    "cost_lut": (cost_lut, f"WITH {_GRID_SQL}, p AS (SELECT r, c, least((v - 3900) * 7, 8191) * 10.0::DOUBLE AS d FROM g WHERE v >= 3900), b AS (SELECT r, c, CASE WHEN d < 50 THEN 1.6::DOUBLE - 0.6::DOUBLE * d / 50 WHEN d <= 9260 THEN 1 ELSE least(1 + 2 * (d - 9260) / 9260, 12) END * [1.19::DOUBLE, 1.1::DOUBLE, 1.0::DOUBLE, 0.8::DOUBLE][c % 4 + 1] AS v FROM p) SELECT r, c, {round_sql('v', 6)} AS cost FROM b"),
}
