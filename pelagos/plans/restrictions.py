"""Queries on the restriction feed: text, rules, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import text as T
from pelagos.operators import restrictions as R
from pelagos.plans.base import FEED_SQL, feed, table


def norm_sql(x: str) -> str:
    return f"upper(trim(translate(replace(coalesce({x}, ''), 'ß', 'SS'), '{T.ACCENTED}', '{T.PLAIN}')))"


def first_sql(x: str, patterns: tuple[str, ...]) -> str:
    return "CAST(coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in patterns) + ") AS BIGINT)"


_COND = "CASE WHEN contains(obs, 'TEMPORAL') OR contains(mot, 'TEMPORAL') THEN 'TEMPORAL' WHEN contains(obs, 'MAL TIEMPO') OR contains(mot, 'MAL TIEMPO') THEN 'MAL_TIEMPO' WHEN contains(obs, 'VARIABLE') OR contains(mot, 'VARIABLE') THEN 'VARIABLE' ELSE 'OTRO' END"
_AREA = f"CASE WHEN contains({norm_sql('area')}, 'DENTRO') AND NOT contains({norm_sql('area')}, 'FUERA') THEN 'DENTRO' WHEN contains({norm_sql('area')}, 'FUERA') AND NOT contains({norm_sql('area')}, 'DENTRO') THEN 'FUERA' ELSE 'DENTRO_Y_FUERA' END"
NORM_SQL = f"""{FEED_SQL},
n0 AS (SELECT *, {norm_sql('observation')} AS obs, {norm_sql('motive')} AS mot, {norm_sql('receives')} AS who FROM feed),
n1 AS (SELECT *, {_COND} AS condition, {_AREA} AS zone,
  contains(who, 'MENOR') OR contains(who, 'TODO') OR contains(obs, 'TODO TIPO DE NAVES') OR contains(obs, 'TODO TIPO DE EMBARCACIONES') AS minors,
  contains(who, 'MAYOR') OR contains(who, 'TODO') OR contains(obs, 'TODO TIPO DE NAVES') AS majors,
  regexp_matches(obs, '{T.ALL_SHIPS}') AS total, {first_sql('obs', T.INSIDE)} AS a, {first_sql('obs', T.OUTSIDE)} AS b, {first_sql('obs', T.THRESHOLDS)} AS c FROM n0),
norm AS (SELECT *, CASE WHEN total THEN NULL WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE c END AS inside,
  CASE WHEN total THEN NULL WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE c END AS outside FROM n1)
"""
_VESSEL = "(CASE WHEN tonnage < 100 THEN tonnage END)"
JUDGED_SQL = f"""{NORM_SQL},
fired AS (
  SELECT id, 10 AS p, 2 AS r, 'temporal' AS rule FROM norm WHERE condition = 'TEMPORAL'
  UNION ALL SELECT id, 9, 2, 'total' FROM norm WHERE total
  UNION ALL SELECT id, 8, 2, 'bad-weather' FROM norm WHERE condition = 'MAL_TIEMPO' AND outside IS NULL AND minors
  UNION ALL SELECT id, 7, 2, 'bad-weather-limit' FROM norm WHERE condition = 'MAL_TIEMPO' AND outside > 0 AND {_VESSEL} < outside
  UNION ALL SELECT id, 6, 1, 'variable-limit' FROM norm WHERE condition = 'VARIABLE' AND outside > 0 AND {_VESSEL} < outside
  UNION ALL SELECT id, 5, 1, 'variable' FROM norm WHERE condition = 'VARIABLE' AND outside IS NULL AND minors
  UNION ALL SELECT id, 4, 1, 'unknown-tonnage' FROM norm WHERE outside > 0 AND {_VESSEL} IS NULL),
best AS (SELECT id, r, rule, row_number() OVER (PARTITION BY id ORDER BY r DESC, p DESC) AS k FROM fired),
judged AS (SELECT n.*, coalesce(b.r, 0) AS rank, b.rule, CASE WHEN b.id IS NULL THEN 'not_affected' WHEN b.r = 2 THEN 'blocks'
  WHEN {_VESSEL} IS NULL AND outside IS NOT NULL THEN 'no_tonnage' ELSE 'caution' END AS state FROM norm n LEFT JOIN best b ON n.id = b.id AND b.k = 1)
"""


def vessel():
    return F.when(F.col("tonnage") < 100, F.col("tonnage"))


def judged(spark, sf):
    return R.judged(feed(spark, sf), vessel())


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


def mojibake_repair(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" REGIÃ“N CAÃ‘Ã‘ON "), F.when(F.col("c_custkey") % 2 == 0, "Ã‰L Ãš")).alias("raw"))
    return d.select("c_custkey", T.repair(F.coalesce("raw", F.lit(""))).alias("name"))


def _pairs(spark, sf):
    return R.normalized(feed(spark, sf))


def classify_condition(spark, sf):
    return _pairs(spark, sf).select("id", "condition")


def legible_condition(spark, sf):
    return feed(spark, sf).select("id", T.legible_condition(F.col("observation"), F.col("motive")).alias("condition"))


def extract_threshold(spark, sf):
    f = feed(spark, sf)
    return f.select("id", T.first_number(T.normalize(F.col("observation")), T.THRESHOLDS).alias("threshold"))


def extract_dual_threshold(spark, sf):
    return _pairs(spark, sf).select("id", "inside", "outside", "total")


def detect_area(spark, sf):
    return _pairs(spark, sf).select("id", "zone")


def normalize_restriction(spark, sf):
    return _pairs(spark, sf).select("id", "bay", "condition", "minors", "majors", "inside", "outside", "total", "zone")


def rule_verdict(spark, sf):
    return judged(spark, sf).select("id", F.col("rank").cast("bigint").alias("rank"), "rule", "state")


def applies_partition(spark, sf):
    return judged(spark, sf).groupBy((F.col("state") != "not_affected").alias("applies")).agg(F.count("*").alias("n"), F.sum((F.col("rank") == 2).cast("bigint")).alias("blocking"))


def _routes(spark, sf):
    rows = judged(spark, sf).where(F.trim("kind") == "TODOS")
    return R.along_route(rows.select("id", "bay", "rank"), "bay", ["id"])


_ROUTES_SQL = f"""{JUDGED_SQL},
r0 AS (SELECT id, bay, rank, row_number() OVER w AS nth, coalesce(max(rank) OVER (PARTITION BY bay ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM judged WHERE trim(kind) = 'TODOS' WINDOW w AS (PARTITION BY bay ORDER BY id)),
routes AS (SELECT *, rank > before AS raises, greatest(rank, before) AS worst, rank = 2 AND before < 2 AS first_block FROM r0)
"""


def route_verdict(spark, sf):
    """A route's worst verdict, its restrictions and the place of the first that blocks. Sums, so that no route meets in one task."""
    rows = judged(spark, sf).where(F.trim("kind") == "TODOS").select("id", "bay", "rank")
    blocked = rows.where("rank = 2").groupBy("bay").agg(F.min("id").alias("at"))
    r = rows.join(blocked, "bay", "left").groupBy("bay").agg(F.max("rank").alias("rank"), F.count("*").alias("n"), F.count_if(F.col("id") <= F.col("at")).alias("k"))
    return r.select("bay", R.verdict(F.col("rank")).alias("verdict"), "n", F.when(F.col("k") > 0, F.col("k")).alias("first_block"))


def running_max_increase(spark, sf):
    return _routes(spark, sf).select("bay", F.col("nth").cast("bigint").alias("nth"), F.col("worst").cast("bigint").alias("worst"), "raises")


def last_safe_segment(spark, sf):
    r = _routes(spark, sf).withColumn("previous", F.lag("id").over(W.Window.partitionBy("bay").orderBy("id")))
    return r.where("first_block").select("bay", F.col("id").alias("blocked_at"), "previous")


def order_in_route(spark, sf):
    return _routes(spark, sf).select("bay", "id", F.col("nth").cast("bigint").alias("nth"))


def verdict_compose(spark, sf):
    """The worst of rules, licence, catalogue drift and coverage; the last two count as caution at most."""
    r = judged(spark, sf).groupBy("bay").agg(F.max("rank").alias("rules"), F.max(F.col("id") % 3).alias("drift"), F.max(F.col("id") % 2 * 2).alias("cover"))
    rank = F.greatest("rules", F.least(F.col("drift"), F.lit(1)), F.least(F.col("cover"), F.lit(1)))
    return r.select("bay", R.verdict(rank).alias("verdict"))


def prefer_matching_row(spark, sf):
    """One row of each bay: the first whose text names a tonnage, else the first."""
    return R.preferred(feed(spark, sf), "bay", F.col("observation").rlike(r"\d+\s*A\.?/?B"), ["id"], ["id", "motive"])


def applies_by_zone(spark, sf):
    return judged(spark, sf).groupBy("zone", "condition").agg(F.count_if(F.col("rank") == 2).alias("blocking"), F.count("*").alias("n"))


def threshold_unit(spark, sf):
    f = feed(spark, sf).select("id", T.normalize(F.col("observation")).alias("obs"))
    unit = F.regexp_replace(F.regexp_extract("obs", r"\d+\s*(A/?\.?B|TRG)", 1), r"[./]", "")
    return f.select("id", F.nullif(unit, F.lit("")).alias("unit"))


def criterion_normalize(spark, sf):
    """Entities decoded, punctuation to blanks, blanks collapsed."""
    d = table(spark, sf, "pages").select("page_id", F.upper(F.replace("html", F.lit("ß"), F.lit("SS"))).alias("t"))
    for entity, mark in (("&LT;", "<"), ("&GT;", ">"), ("&AMP;", "&"), ("&NBSP;", " ")):
        d = d.withColumn("t", F.replace("t", F.lit(entity), F.lit(mark)))
    clean = F.trim(F.regexp_replace(F.regexp_replace("t", r"[.,;:()/\-]", " "), r"\s+", " "))
    return d.select("page_id", F.md5(clean.cast("binary")).alias("digest"), F.length(clean).cast("bigint").alias("n"))


def closure_state(spark, sf):
    """Whether the text closes the port: said outright, or by condition and area; fog banks do not."""
    f = _pairs(spark, sf).withColumn("o", T.normalize(F.col("observation")))
    said = F.col("o").rlike(r"\b(PUERTO|PURTO)\s+CERRADO\b")
    net = F.col("condition").isin("TEMPORAL", "MAL_TIEMPO") & F.col("total")
    return f.select("id", F.when(F.col("o") == "", "unreadable").when(said, "closed").when(net, "closed").otherwise("open").alias("state"), F.when(said, "said").when(net, "net").alias("via"))


def template_fill(spark, sf):
    j = judged(spark, sf)
    line = F.replace(F.replace(F.lit("AB {vessel} under {limit}"), F.lit("{vessel}"), F.coalesce(vessel().cast("string"), F.lit("?"))), F.lit("{limit}"), F.coalesce(F.col("outside").cast("string"), F.lit("?")))
    return j.select("id", line.alias("line"))


def exclude_endpoints(spark, sf):
    r = _routes(spark, sf)
    ends = r.groupBy("bay").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return r.join(ends, "bay").where((F.col("id") != F.col("first")) & (F.col("id") != F.col("last"))).groupBy("bay").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def restrictions_on_route(spark, sf):
    """The flagship: restrictions in transit on each route's bays, one row a bay in order, judged and folded."""
    rows = feed(spark, sf).where(F.trim("kind") == "TODOS").withColumn("says", F.col("observation").rlike(r"(?i)\d+\s*A\.?/?B"))
    one = R.preferred(rows, "bay", F.col("says"), ["id"], [c for c in rows.columns if c != "bay"])
    route = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("bay"), F.col("n_regionkey").cast("bigint").alias("route"), F.col("n_name").alias("name"))
    done = R.along_route(R.judged(one, vessel()).join(F.broadcast(route), "bay"), "route", ["bay"])
    return done.select("route", F.col("nth").cast("bigint").alias("nth"), "bay", "name", "condition", "outside", "state", R.verdict(F.col("rank")).alias("verdict"), R.verdict(F.col("worst")).alias("so_far"))


_V = "CASE {} WHEN 2 THEN 'UV' WHEN 1 THEN 'U' ELSE 'Q' END"
QUERIES = {
    "restrictions_on_route": (restrictions_on_route, f"""WITH {JUDGED_SQL},
one AS (SELECT id, row_number() OVER (PARTITION BY bay ORDER BY CASE WHEN regexp_matches(coalesce(observation, ''), '(?i)\\d+\\s*A\\.?/?B') THEN 0 ELSE 1 END, id) AS k FROM feed WHERE trim(kind) = 'TODOS'),
r AS (SELECT n.n_regionkey::BIGINT AS route, j.*, n.n_name AS name FROM judged j JOIN one USING (id) JOIN nation n ON n.n_nationkey = j.bay WHERE one.k = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY bay) AS nth, max(rank) OVER (PARTITION BY route ORDER BY bay) AS worst FROM r)
SELECT route, nth, bay, name, condition, outside, state, {_V.format('rank')} AS verdict, {_V.format('worst')} AS so_far FROM w"""),
    "normalize_text": (normalize_text, f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents"),
    "mojibake_repair": (mojibake_repair, """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' REGION CANNON EL U' ELSE '' END AS name FROM customer"""),
    "classify_condition": (classify_condition, f"WITH {NORM_SQL} SELECT id, condition FROM norm"),
    "legible_condition": (legible_condition, f"""WITH {FEED_SQL} SELECT id, CASE WHEN contains(upper(coalesce(observation, '')), 'TEMPORAL') THEN 'Temporal' WHEN contains(upper(coalesce(observation, '')), 'MAL TIEMPO') THEN 'Mal Tiempo'
      WHEN contains(upper(coalesce(observation, '')), 'TIEMPO VARIABLE') THEN 'Tiempo Variable' WHEN contains(upper(coalesce(observation, '')), 'CERRADO') THEN 'Puerto Cerrado'
      WHEN trim(coalesce(motive, '')) <> '' THEN upper(substr(trim(motive), 1, 1)) || lower(substr(trim(motive), 2)) END AS condition FROM feed"""),
    "extract_threshold": (extract_threshold, f"WITH {NORM_SQL} SELECT id, c AS threshold FROM norm"),
    "extract_dual_threshold": (extract_dual_threshold, f"WITH {NORM_SQL} SELECT id, inside, outside, total FROM norm"),
    "detect_area": (detect_area, f"WITH {NORM_SQL} SELECT id, zone FROM norm"),
    "normalize_restriction": (normalize_restriction, f"WITH {NORM_SQL} SELECT id, bay, condition, minors, majors, inside, outside, total, zone FROM norm"),
    "rule_verdict": (rule_verdict, f"WITH {JUDGED_SQL} SELECT id, rank::BIGINT AS rank, rule, state FROM judged"),
    "applies_partition": (applies_partition, f"WITH {JUDGED_SQL} SELECT state <> 'not_affected' AS applies, count(*) AS n, sum((rank = 2)::INT)::BIGINT AS blocking FROM judged GROUP BY 1"),
    "route_verdict": (route_verdict, f"WITH {_ROUTES_SQL} SELECT bay, {_V.format('max(rank)')} AS verdict, count(*) AS n, min(nth) FILTER (WHERE rank = 2) AS first_block FROM routes GROUP BY bay"),
    "running_max_increase": (running_max_increase, f"WITH {_ROUTES_SQL} SELECT bay, nth, worst::BIGINT AS worst, raises FROM routes"),
    "last_safe_segment": (last_safe_segment, f"WITH {_ROUTES_SQL}, p AS (SELECT *, lag(id) OVER (PARTITION BY bay ORDER BY id) AS previous FROM routes) SELECT bay, id AS blocked_at, previous FROM p WHERE first_block"),
    "order_in_route": (order_in_route, f"WITH {_ROUTES_SQL} SELECT bay, id, nth FROM routes"),
    "verdict_compose": (verdict_compose, f"WITH {JUDGED_SQL} SELECT bay, {_V.format('greatest(max(rank), least(max(id % 3), 1), least(max(id % 2 * 2), 1))')} AS verdict FROM judged GROUP BY bay"),
    "prefer_matching_row": (prefer_matching_row, f"""WITH {FEED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY bay ORDER BY CASE WHEN regexp_matches(coalesce(observation, ''), '\\d+\\s*A\\.?/?B') THEN 0 ELSE 1 END, id) AS k FROM feed)
      SELECT bay, id, motive FROM o WHERE k = 1"""),
    "applies_by_zone": (applies_by_zone, f"WITH {JUDGED_SQL} SELECT zone, condition, count(*) FILTER (WHERE rank = 2) AS blocking, count(*) AS n FROM judged GROUP BY ALL"),
    "threshold_unit": (threshold_unit, f"WITH {NORM_SQL} SELECT id, nullif(replace(replace(regexp_extract(obs, '\\d+\\s*(A/?\\.?B|TRG)', 1), '.', ''), '/', ''), '') AS unit FROM norm"),
    "criterion_normalize": (criterion_normalize, """WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(upper(replace(html, 'ß', 'SS')), '&LT;', '<'), '&GT;', '>'), '&AMP;', '&'), '&NBSP;', ' '), '[.,;:()/\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)
      SELECT page_id, md5(t) AS digest, length(t)::BIGINT AS n FROM c"""),
    "closure_state": (closure_state, f"""WITH {NORM_SQL} SELECT id, CASE WHEN obs = '' THEN 'unreadable' WHEN regexp_matches(obs, '\\b(PUERTO|PURTO)\\s+CERRADO\\b') OR (condition IN ('TEMPORAL', 'MAL_TIEMPO') AND total) THEN 'closed' ELSE 'open' END AS state,
      CASE WHEN regexp_matches(obs, '\\b(PUERTO|PURTO)\\s+CERRADO\\b') THEN 'said' WHEN condition IN ('TEMPORAL', 'MAL_TIEMPO') AND total THEN 'net' END AS via FROM norm"""),
    "template_fill": (template_fill, f"WITH {NORM_SQL} SELECT id, 'AB ' || coalesce({_VESSEL}::VARCHAR, '?') || ' under ' || coalesce(outside::VARCHAR, '?') AS line FROM norm"),
    "exclude_endpoints": (exclude_endpoints, f"""WITH {_ROUTES_SQL}, e AS (SELECT bay, min(id) AS a, max(id) AS z FROM routes GROUP BY bay)
      SELECT bay, count(*) AS n, sum(id)::BIGINT AS ids FROM routes JOIN e USING (bay) WHERE id <> a AND id <> z GROUP BY bay"""),
}
