"""Queries on catalogues: search, counts, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import text as T
from pelagos.functions.num import half_up, tolerant_number
from pelagos.operators.ranking import ranked
from pelagos.plans.base import lat, lat_sql, lng, lng_sql, round_sql, table
from pelagos.plans.restrictions import norm_sql

W_ = W.Window


def multi_field_search(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose name, brand or type holds the wanted text, accents and case aside; of one size where asked."""
    p, want = table(spark, sf, "part"), "BRASS"
    hit = T.normalize(F.col("p_name")).contains(want) | T.normalize(F.col("p_brand")).contains(want) | T.normalize(F.col("p_type")).contains(want)
    return p.where(hit & F.col("p_size").between(5, 30)).select("p_partkey", "p_name", "p_type").orderBy("p_partkey").limit(200)


def safe_query_filter(spark, sf):
    """Whether a text may be a query: short enough, and of letters, digits and a few marks alone."""
    safe = (F.length("text") <= 100) & F.col("text").rlike(r"\A[\p{L}\p{N}\s\-.]+\z")
    return table(spark, sf, "documents").select("doc_id", safe.alias("safe"))


def prefix_ranked_search(spark, sf):
    p, name = table(spark, sf, "part"), T.normalize(F.col("p_name"))
    hits = p.where(name.contains("A")).withColumn("rank", F.when(name.startswith("A"), 0).otherwise(1))
    return hits.orderBy("rank", "p_name", "p_partkey").limit(50).select(F.col("rank").cast("bigint").alias("rank"), "p_name", "p_partkey")


def tolerant_id_match(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, " ").when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 4 == 2, "x1").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("raw"))
    c = table(spark, sf, "customer").select("c_custkey")
    return o.withColumn("key", tolerant_number(F.col("raw"))).join(c, F.col("key") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


def valid_points_bbox(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", lat("c_custkey").alias("lat"), lng("c_custkey").alias("lng"))
    ok = p.where(F.col("lat").between(-50, -25) & F.col("lng").between(-74, -68) & ~F.isnan("lat") & ~F.isnan("lng"))
    return ok.select("c_custkey", half_up(F.col("lat"), 6).alias("lat"), half_up(F.col("lng"), 6).alias("lng"))


def bbox_layer_scan(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", lat("s_suppkey").alias("lat"), lng("s_suppkey").alias("lng"))
    return p.where(F.col("lat").between(-45, -20) & F.col("lng").between(-75, -67) & F.col("s_nationkey").isin(1, 3, 5, 7, 11, 13)).orderBy("s_suppkey").limit(500).select("s_suppkey", "s_nationkey")


def paginated_recent(spark, sf):
    o = table(spark, sf, "orders")
    total = o.agg(F.count("*").alias("total"))
    page = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)
    return page.crossJoin(F.broadcast(total)).select("o_orderkey", "o_orderdate", "total")


def row_validation_errors(spark, sf):
    """Every error of a row in one array, in the order of the checks."""
    p = table(spark, sf, "part")
    errors = F.array_compact(F.array(
        F.when(~F.substring("p_brand", 7, 1).isin("1", "2", "3"), F.lit("brand")), F.when(F.col("p_size") > 40, F.lit("size")),
        F.when(F.col("p_retailprice") < 905, F.lit("price")),
    ))
    return p.select("p_partkey", F.array_join(errors, ",").alias("errors")).where("errors <> ''")


def group_counts(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(F.col("c_mktsegment").isNotNull() & (F.trim("c_mktsegment") != "")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def multi_dim_counts(spark, sf):
    o = table(spark, sf, "orders")
    return spark.sql("""SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'year' END AS dim,
      coalesce(o_orderstatus, o_orderpriority, cast(y AS string)) AS value, count(*) AS n
      FROM (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y FROM {orders}) GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (y))""", orders=o)


def split_explode_counts(spark, sf):
    p = table(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("w")).select(F.upper(F.trim("w")).alias("word")).where("word <> ''")
    return p.groupBy("word").agg(F.count("*").alias("n"))


def region_rollup(spark, sf):
    n, r, c = (table(spark, sf, x) for x in ("nation", "region", "customer"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name").agg(F.count("*").alias("n"), half_up(F.sum("c_acctbal"), 2).alias("total")).select(F.coalesce("r_name", F.lit("TOTAL")).alias("region"), "n", "total")


def filtered_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") == 0).alias("zero"), F.count_if(F.col("l_quantity") > 30).alias("large"), F.count_if(F.col("l_tax").isNull()).alias("empty")
    )


def case_category_counts(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type").like("%BRASS"), "brass").when(F.col("p_type").like("%STEEL"), "steel").when(F.col("p_type").like("STANDARD%"), "standard").otherwise("other")
    return p.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def having_threshold(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last")).where(F.col("n") > 15)


def boolagg_listagg(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(
        F.bool_and(F.col("o_orderstatus") == "F").alias("all_final"),
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")))), "; ").alias("open_priorities"),
    )


def distinct_and_extrema(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_linestatus").agg(
        F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
        half_up(F.avg(F.abs(F.col("l_quantity") - 25)), 6).alias("spread"),
    )


def unique_claim(spark, sf):
    """Orders whose lines all come from one supplier."""
    li = table(spark, sf, "lineitem").where("l_quantity > 0")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids"))
    return g.where(F.size("ids") == 1).select("l_orderkey", F.element_at("ids", 1).alias("supplier"))


def keyword_counts(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where(F.col("word").isin("the", "and", "que", "der", "les"))
    return d.groupBy("lang", "word").agg(F.count("*").alias("n"))


def signature_counts(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), "+").alias("signature"))
    return li.groupBy("signature").agg(F.count("*").alias("n"))


def group_divergence(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("kinds"))
    return o.where("n >= 2 and kinds > 1")


def snapshot_changes(spark, sf):
    """Bays whose text differs between captures."""
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 500).alias("bay"), F.year("o_orderdate").cast("bigint").alias("capture")).agg(F.min("o_orderpriority").alias("text"))
    return o.groupBy("bay").agg(F.count_distinct("text").alias("texts"), F.count("*").alias("captures")).where("texts > 1")


def snapshot_partial_presence(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("bay"), F.year("o_orderdate").alias("y")).distinct()
    total = o.agg(F.count_distinct("y").alias("total"))
    return o.groupBy("bay").agg(F.count("*").alias("seen")).crossJoin(F.broadcast(total)).where("seen < total")


def capture_summary(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.date_trunc("month", "o_orderdate").alias("capture")).agg(F.count("*").alias("n"), F.count_distinct(F.col("o_custkey") % 25).alias("bays"), F.count_if(F.col("o_custkey") % 4 == 1).alias("minors"))


def coverage_pct(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") > 0.09).alias("n"), F.count_if(F.col("l_tax") > 0.07).alias("of"))
    return li.select("l_suppkey", F.when(F.col("of") > 0, half_up(100.0 * F.col("n") / F.col("of"), 4)).alias("pct"))


def partition_closes(spark, sf):
    o = table(spark, sf, "orders").agg(F.count("*").alias("n"), *(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"))
    return o.select("n", (F.col("f") + F.col("o") + F.col("p") == F.col("n")).alias("closes"))


def hazards_by_group(spark, sf):
    """Per brand its names once each (case aside, the first stays), in order, in one sentence."""
    p = table(spark, sf, "part").withColumn("key", T.normalize(F.col("p_type")))
    one = p.groupBy("p_brand", "key").agg(F.min_by("p_type", "p_partkey").alias("name"))
    g = one.groupBy("p_brand").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return g.select("p_brand", F.size("names").cast("bigint").alias("n"), F.md5(F.array_join("names", "; ").cast("binary")).alias("digest"))


def nulls_last_sort(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    places = ranked(d.select("doc_id", "quality", "n_chars"), [F.desc_nulls_last("quality"), F.asc("n_chars"), F.asc("doc_id")], "place")
    return places.select("doc_id", F.col("quality").cast("bigint").alias("quality"), "place")


def top_abs_difference(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", half_up(F.abs(F.col("s_acctbal") - 5000), 2).alias("gap")).orderBy(F.desc("gap"), "s_suppkey").limit(10)


def union_layers(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("layer"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("layer"))
    return c.unionByName(s).groupBy("layer", "nation").agg(F.count("*").alias("n")).select("layer", F.col("nation").cast("bigint").alias("nation"), "n")


def additive_union(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return o.union(table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


def intersect_all_sources(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    return a.intersect(b).intersect(table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"))


def symmetric_difference(spark, sf):
    a = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    b = table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("a")).union(b.join(a, "id", "left_anti").withColumn("side", F.lit("b")))


def union_first_wins(spark, sf):
    """Names of several sources, the source with the first rank keeps the name."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("rank"), F.col("n_nationkey").cast("bigint").alias("id"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit(2).alias("rank"), F.col("r_regionkey").cast("bigint").alias("id"))
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.lit(3).alias("rank"), F.col("c_custkey").alias("id"))
    return n.union(r).union(c).groupBy(T.normalize(F.col("name")).alias("name")).agg(F.min(F.struct("rank", "id")).alias("m")).select("name", F.col("m.rank").cast("bigint").alias("rank"), "m.id")


def declared_vs_observed(spark, sf):
    d = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    o = table(spark, sf, "documents").where("n_chars < 600").select(F.col("doc_id").alias("id"))
    j = d.withColumn("d", F.lit(1)).join(o.withColumn("o", F.lit(1)), "id", "full")
    return j.select("id", F.when(F.col("d").isNull(), "undeclared").when(F.col("o").isNull(), "expired").otherwise("declared").alias("state"))


def upsert_latest(spark, sf):
    """Customers with newer rows of orders put over their own balance."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    return base.join(new, "id", "left_anti").unionByName(new)


def latest_per_key(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def retire_unpublished(spark, sf):
    gone = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf, "documents").join(gone, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def content_fingerprint(spark, sf):
    """A digest of each row's content without the time it was taken."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.sha2(F.concat_ws("|", "user_id", "event_type", F.coalesce("props", F.lit(""))), 256).alias("digest"))


def csv_escape_line(spark, sf):
    d = table(spark, sf, "benchmark")
    t = F.concat("text", F.when(F.col("item_id") % 2 == 0, ' "q"').otherwise(""))
    quoted = F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    return d.select("item_id", F.concat_ws(",", F.col("item_id").cast("string"), quoted).alias("line"))


def infer_type_prefix(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type").startswith("SMALL"), "small").when(F.col("p_type").startswith("LARGE"), "large").when(F.col("p_type").startswith("MEDIUM"), "medium").otherwise("other")
    return p.select("p_partkey", kind.alias("kind"))


def prefix_strip_match(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.trim(F.regexp_replace(F.lower("p_type"), r"^(small|large|medium|standard|economy|promo)\s+", "")).alias("bare"))
    return p.groupBy("bare").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def edit_distance(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i"))
    m = table(spark, sf, "nation").select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("j"))
    return n.join(m, F.col("i") < F.col("j")).select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("d"))


def bucket_key(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", half_up(F.col("value") / 0.5, 0).alias("half"), F.date_trunc("hour", "ts").alias("hour"))


def phone_atomic(spark, sf):
    """Telephone numbers read from text, and whether a cell holds one alone."""
    raw = F.concat(F.lit("+56 (65) "), (F.col("c_custkey") % 900 + 100).cast("string"), F.lit(" "), (F.col("c_custkey") * 7 % 9000 + 1000).cast("string"), F.when(F.col("c_custkey") % 3 == 0, " ó 123456").otherwise(""))
    c = table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", F.regexp_replace("raw", r"[^0-9]", "").alias("digits"), (F.size(F.split("raw", r"ó|/")) == 1).alias("atomic"))


def digit_run_guard(spark, sf):
    d = table(spark, sf, "documents")
    runs = F.expr(r"exists(regexp_extract_all(text, '[0-9][0-9 ()+]*', 0), x -> length(regexp_replace(x, '[^0-9]', '')) >= 6)")
    return d.select("doc_id", runs.alias("held"))


_DIMS = "SELECT o_orderstatus AS s, o_orderpriority AS p, year(o_orderdate) AS y FROM orders"
QUERIES = {
    "multi_field_search": (multi_field_search, f"SELECT p_partkey, p_name, p_type FROM part WHERE (contains({norm_sql('p_name')}, 'BRASS') OR contains({norm_sql('p_brand')}, 'BRASS') OR contains({norm_sql('p_type')}, 'BRASS')) AND p_size BETWEEN 5 AND 30 ORDER BY p_partkey LIMIT 200"),
    "safe_query_filter": (safe_query_filter, r"SELECT doc_id, length(text) <= 100 AND regexp_matches(text, '\A[\p{L}\p{N}\s\-.]+\z') AS safe FROM documents"),
    "prefix_ranked_search": (prefix_ranked_search, f"SELECT CASE WHEN starts_with({norm_sql('p_name')}, 'A') THEN 0 ELSE 1 END::BIGINT AS rank, p_name, p_partkey FROM part WHERE contains({norm_sql('p_name')}, 'A') ORDER BY rank, p_name, p_partkey LIMIT 50"),
    "tolerant_id_match": (tolerant_id_match, "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 IN (1, 3)"),
    "valid_points_bbox": (valid_points_bbox, f"WITH p AS (SELECT c_custkey, {lat_sql('c_custkey')} AS lat, {lng_sql('c_custkey')} AS lng FROM customer) SELECT c_custkey, {round_sql('lat', 6)} AS lat, {round_sql('lng', 6)} AS lng FROM p WHERE lat BETWEEN -50 AND -25 AND lng BETWEEN -74 AND -68"),
    "bbox_layer_scan": (bbox_layer_scan, f"SELECT s_suppkey, s_nationkey FROM supplier WHERE {lat_sql('s_suppkey')} BETWEEN -45 AND -20 AND {lng_sql('s_suppkey')} BETWEEN -75 AND -67 AND s_nationkey IN (1,3,5,7,11,13) ORDER BY s_suppkey LIMIT 500"),
    "paginated_recent": (paginated_recent, "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40"),
    "row_validation_errors": (row_validation_errors, "SELECT p_partkey, concat_ws(',', CASE WHEN substr(p_brand, 7, 1) NOT IN ('1','2','3') THEN 'brand' END, CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_retailprice < 905 THEN 'price' END) AS errors FROM part WHERE errors <> ''"),
    "group_counts": (group_counts, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1"),
    "multi_dim_counts": (multi_dim_counts, f"WITH o AS ({_DIMS}) SELECT 'status' AS dim, s AS value, count(*) AS n FROM o GROUP BY s UNION ALL SELECT 'priority', p, count(*) FROM o GROUP BY p UNION ALL SELECT 'year', y::VARCHAR, count(*) FROM o GROUP BY y"),
    "split_explode_counts": (split_explode_counts, "WITH w AS (SELECT upper(trim(unnest(string_split(p_type, ' ')))) AS word FROM part) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1"),
    "region_rollup": (region_rollup, f"SELECT coalesce(r_name, 'TOTAL') AS region, count(*) AS n, {round_sql('sum(c_acctbal)', 2)} AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)"),
    "filtered_counts": (filtered_counts, "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS zero, count(*) FILTER (WHERE l_quantity > 30) AS large, count(*) FILTER (WHERE l_tax IS NULL) AS empty FROM lineitem GROUP BY 1"),
    "case_category_counts": (case_category_counts, "SELECT CASE WHEN p_type LIKE '%BRASS' THEN 'brass' WHEN p_type LIKE '%STEEL' THEN 'steel' WHEN p_type LIKE 'STANDARD%' THEN 'standard' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1"),
    "having_threshold": (having_threshold, "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "boolagg_listagg": (boolagg_listagg, "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_final, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities, coalesce(string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), '') AS open_priorities FROM orders GROUP BY 1"),
    "distinct_and_extrema": (distinct_and_extrema, f"SELECT l_linestatus, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first, max(l_shipdate) AS last, {round_sql('avg(abs(l_quantity - 25))', 6)} AS spread FROM lineitem GROUP BY 1"),
    "unique_claim": (unique_claim, "SELECT l_orderkey, min(l_suppkey) AS supplier FROM lineitem WHERE l_quantity > 0 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1"),
    "keyword_counts": (keyword_counts, r"WITH w AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) SELECT lang, word, count(*) AS n FROM w WHERE word IN ('the','and','que','der','les') GROUP BY ALL"),
    "signature_counts": (signature_counts, "WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '+' ORDER BY l_returnflag || l_linestatus) AS signature FROM lineitem GROUP BY 1) SELECT signature, count(*) AS n FROM s GROUP BY 1"),
    "group_divergence": (group_divergence, "SELECT o_custkey, date_trunc('month', o_orderdate) AS month, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT o_orderstatus) > 1"),
    "snapshot_changes": (snapshot_changes, "WITH c AS (SELECT o_custkey % 500 AS bay, year(o_orderdate) AS y, min(o_orderpriority) AS text FROM orders GROUP BY 1, 2) SELECT bay, count(DISTINCT text) AS texts, count(*) AS captures FROM c GROUP BY 1 HAVING count(DISTINCT text) > 1"),
    "snapshot_partial_presence": (snapshot_partial_presence, "WITH c AS (SELECT DISTINCT o_custkey % 700 AS bay, year(o_orderdate) AS y FROM orders), t AS (SELECT count(DISTINCT y) AS total FROM c) SELECT bay, count(*) AS seen, total FROM c, t GROUP BY bay, total HAVING count(*) < total"),
    "capture_summary": (capture_summary, "SELECT date_trunc('month', o_orderdate) AS capture, count(*) AS n, count(DISTINCT o_custkey % 25) AS bays, count(*) FILTER (WHERE o_custkey % 4 = 1) AS minors FROM orders GROUP BY 1"),
    "coverage_pct": (coverage_pct, f"SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE l_tax > 0.07) > 0 THEN {round_sql('100.0::DOUBLE * count(*) FILTER (WHERE l_discount > 0.09) / count(*) FILTER (WHERE l_tax > 0.07)', 4)} END AS pct FROM lineitem GROUP BY 1"),
    "partition_closes": (partition_closes, "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus IN ('F','O','P')) = count(*) AS closes FROM orders"),
    "hazards_by_group": (hazards_by_group, f"WITH o AS (SELECT p_brand, {norm_sql('p_type')} AS key, arg_min(p_type, p_partkey) AS name FROM part GROUP BY 1, 2) SELECT p_brand, count(*) AS n, md5(string_agg(name, '; ' ORDER BY name)) AS digest FROM o GROUP BY 1"),
    "nulls_last_sort": (nulls_last_sort, "SELECT doc_id, quality::BIGINT AS quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, n_chars, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)"),
    "top_abs_difference": (top_abs_difference, f"SELECT s_suppkey, {round_sql('abs(s_acctbal - 5000)', 2)} AS gap FROM supplier ORDER BY gap DESC, s_suppkey LIMIT 10"),
    "union_layers": (union_layers, "WITH u AS (SELECT 'customer' AS layer, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) SELECT layer, nation::BIGINT AS nation, count(*) AS n FROM u GROUP BY ALL"),
    "additive_union": (additive_union, "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "intersect_all_sources": (intersect_all_sources, "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0"),
    "symmetric_difference": (symmetric_difference, "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '5-LOW') (SELECT id, 'a' AS side FROM a EXCEPT SELECT id, 'a' FROM b) UNION ALL (SELECT id, 'b' FROM b EXCEPT SELECT id, 'b' FROM a)"),
    "union_first_wins": (union_first_wins, f"WITH u AS (SELECT n_name AS name, 1 AS rank, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT r_name, 2, r_regionkey FROM region UNION ALL SELECT c_mktsegment, 3, c_custkey FROM customer), k AS (SELECT {norm_sql('name')} AS name, rank, id, row_number() OVER (PARTITION BY {norm_sql('name')} ORDER BY rank, id) AS k FROM u) SELECT name, rank::BIGINT AS rank, id FROM k WHERE k = 1"),
    "declared_vs_observed": (declared_vs_observed, "WITH d AS (SELECT doc_id AS id FROM labels WHERE quality = 0), o AS (SELECT doc_id AS id FROM documents WHERE n_chars < 600) SELECT coalesce(d.id, o.id) AS id, CASE WHEN d.id IS NULL THEN 'undeclared' WHEN o.id IS NULL THEN 'expired' ELSE 'declared' END AS state FROM d FULL JOIN o ON d.id = o.id"),
    "upsert_latest": (upsert_latest, "WITH n AS (SELECT o_custkey AS id, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT id, value FROM n WHERE k = 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "latest_per_key": (latest_per_key, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "retire_unpublished": (retire_unpublished, "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1"),
    "content_fingerprint": (content_fingerprint, "SELECT event_id, sha256(user_id || '|' || event_type || '|' || coalesce(props, '')) AS digest FROM events"),
    "csv_escape_line": (csv_escape_line, """WITH t AS (SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' "q"' ELSE '' END AS t FROM benchmark) SELECT item_id, item_id || ',' || CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS line FROM t"""),
    "infer_type_prefix": (infer_type_prefix, "SELECT p_partkey, CASE WHEN p_type LIKE 'SMALL%' THEN 'small' WHEN p_type LIKE 'LARGE%' THEN 'large' WHEN p_type LIKE 'MEDIUM%' THEN 'medium' ELSE 'other' END AS kind FROM part"),
    "prefix_strip_match": (prefix_strip_match, r"SELECT trim(regexp_replace(lower(p_type), '^(small|large|medium|standard|economy|promo)\s+', '')) AS bare, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1"),
    "edit_distance": (edit_distance, "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
    "bucket_key": (bucket_key, f"SELECT event_id, {round_sql('value / 0.5::DOUBLE', 0)} AS half, date_trunc('hour', ts) AS hour FROM events"),
    "phone_atomic": (phone_atomic, "WITH r AS (SELECT c_custkey, '+56 (65) ' || (c_custkey % 900 + 100) || ' ' || (c_custkey * 7 % 9000 + 1000) || CASE WHEN c_custkey % 3 = 0 THEN ' ó 123456' ELSE '' END AS raw FROM customer) SELECT c_custkey, regexp_replace(raw, '[^0-9]', '', 'g') AS digits, len(regexp_split_to_array(raw, 'ó|/')) = 1 AS atomic FROM r"),
    "digit_run_guard": (digit_run_guard, "SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9][0-9 ()+]*'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 6)) > 0 AS held FROM documents"),
}
