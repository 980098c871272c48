"""Queries that compare sources: bridges, resolvers, drift, tie-breaks, audits and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import text as T
from pelagos.operators import names
from pelagos.plans.base import table
from pelagos.plans.restrictions import norm_sql

W_ = W.Window


def lookup_with_default(spark: SparkSession, sf: str) -> DataFrame:
    """Each bay's office, or the sentinel for one that no table knows."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("bay"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("bay"), "n_name")
    return o.join(F.broadcast(n), "bay", "left").select("id", F.coalesce("n_name", F.lit("Desconocida")).alias("office"))


def two_role_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    a, b = n.select(F.col("k").alias("a"), F.col("n_name").alias("entry")), n.select(F.col("k").alias("b"), F.col("n_name").alias("exit"))
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("a"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 25).alias("b"))
    j = o.join(F.broadcast(a), "a").join(F.broadcast(b), "b", "left")
    return j.select("o_orderkey", F.concat_ws(" > ", "entry", "exit").alias("route"))


def resolver_coalesce(spark, sf):
    """The first source's office, the second's only where the first has none, and which one it was."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    first = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"))
    second = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k2"), F.lower("n_name").alias("y"))
    j = c.join(F.broadcast(first), F.col("c_nationkey") == F.col("k"), "left").join(F.broadcast(second), F.col("c_nationkey") == F.col("k2"), "left")
    return j.select("c_custkey", F.coalesce("x", "y").alias("office"), F.when(F.col("x").isNotNull(), "first").when(F.col("y").isNotNull(), "second").alias("source"))


def anti_unknown_ids(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("bay")).distinct()
    return o.join(table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("bay")), "bay", "left_anti")


def drift_in_route(spark, sf):
    """Unknown bays whose office is one of the route's."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("bay"), (F.col("o_custkey") % 7).alias("office"))
    known = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("bay"))
    route = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("office"))
    return o.join(known, "bay", "left_anti").join(route, "office", "left_semi").groupBy("bay").agg(F.count("*").alias("n"))


def bridge_any_match(spark, sf):
    """Bays of a jurisdiction, which may name further ones besides its own."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("bay"), F.explode(F.array_union(F.array("n_regionkey"), F.array(((F.col("n_nationkey") * 3) % 7).cast("int")))).alias("jurisdiction"))
    wanted = table(spark, sf, "region").where("r_regionkey in (1, 3)").select(F.col("r_regionkey").alias("jurisdiction"))
    return n.join(wanted, "jurisdiction", "left_semi").select("bay").distinct()


def catalog_drift(spark, sf):
    """Which sources hold an id; those that not all hold are drift, of a class."""
    src = lambda name, df: df.select("id").distinct().withColumn("src", F.lit(name))
    a = src("a", table(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id")))
    b = src("b", table(spark, sf, "orders").select(F.col("o_custkey").alias("id")))
    c = src("c", table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    m = a.union(b).union(c).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("src")), "").alias("held"))
    return m.groupBy("held").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("state", F.when(F.col("held") == "abc", "same").otherwise("drift"))


def merge_origins(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.lit("customer").alias("src"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("name"), F.col("c_custkey").alias("ord"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("supplier").alias("src"), F.col("s_name").alias("name"), (F.col("s_suppkey") + 10_000_000).alias("ord"))
    return c.union(s).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("src")), "+").alias("origins"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"))


def source_agreement(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("a"))
    b = table(spark, sf, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") % 2 == 0, 1).when(F.col("n_chars") % 5 != 0, 0).alias("b"))
    j = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "doc_id", "full")
    state = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "missing").when(F.col("a").isNull() | F.col("b").isNull(), "null").when(F.col("a") == F.col("b"), "agree").otherwise("disagree")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def two_key_match(spark, sf):
    """By name; else by a telephone that one office alone has; else a reason."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 2000).cast("string"), 9, "0")).alias("name"), (F.col("c_custkey") % 97).alias("phone"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 97).alias("p"))
    one = s.groupBy("p").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("by_phone"))
    names = s.groupBy("s_name").agg(F.min("s_suppkey").alias("by_name"))
    j = c.join(names, F.col("name") == F.col("s_name"), "left").join(one, F.col("phone") == F.col("p"), "left")
    alone = F.when(F.col("n") == 1, F.col("by_phone"))
    how = F.when(F.col("by_name").isNotNull(), "name").when(alone.isNotNull(), "phone").when(F.col("n") > 1, "phone shared").otherwise("unknown")
    return j.select("c_custkey", F.coalesce("by_name", alone).alias("supplier"), how.alias("how"))


def name_match_status(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", T.normalize(F.col("p_type")).alias("key"))
    k = p.groupBy("key").agg(F.count("*").alias("n"))
    return p.join(k, "key").groupBy(F.when(F.col("n") == 1, "SI").when(F.col("n") <= 12, "DUDOSO").otherwise("NO").alias("status")).agg(F.count("*").alias("parts"))


def name_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's water among those named after parts: as it is, without its noun, or only alike."""
    known = table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("k"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 150).cast("string")).alias("name"), "p_name")
    kind = F.col("s_suppkey") % 4
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), (F.col("s_suppkey").cast("bigint") * 2).alias("k"), kind.alias("kind")).join(known, "k")
    name = F.when(F.col("kind") == 0, F.col("name")).when(F.col("kind") == 1, F.concat(F.lit("Laguna "), "name")).when(F.col("kind") == 2, F.concat(F.lit("Lago "), "p_name", F.lit("es"))).otherwise(F.concat("name", F.lit(" qqqq")))
    return names.name_matches(s.select("id", name.alias("name")), known.select("name"))


def token_mention_join(spark, sf):
    """Benchmark items whose first three words all occur in a document."""
    words = lambda t: F.array_distinct(F.array_remove(F.split(F.lower(t), r"\s+"), ""))
    b = table(spark, sf, "benchmark").select("item_id", F.slice(words("text"), 1, 3).alias("w"))
    want = b.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(words("text")).alias("word"))
    return d.join(want, "word").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("k")).where("k = n").groupBy("item_id").agg(F.count("*").alias("documents"))


def shared_vertex_pairs(spark, sf):
    """Suppliers that share two vertices or more: parts at a place in an order."""
    v = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    w = v.withColumnRenamed("l_suppkey", "b")
    return v.join(w, ["l_partkey", "l_linenumber"]).where("l_suppkey < b").groupBy(F.col("l_suppkey").alias("a"), "b").agg(F.count("*").alias("n")).where("n >= 2")


def lateral_metrics(spark, sf):
    o = table(spark, sf, "orders")
    return spark.sql("""SELECT o.o_orderpriority, sum(x.big) AS big, sum(x.n) AS n FROM {o} o, LATERAL (SELECT count_if(l.l_quantity > 25) AS big, count(*) AS n FROM {l} l WHERE l.l_orderkey = o.o_orderkey) x GROUP BY 1""", o=o, l=table(spark, sf, "lineitem"))


def controls_by_group(spark, sf):
    """Faults by nation, those without any too."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    bad = table(spark, sf, "supplier").where("s_acctbal < 0").select("s_nationkey", "s_suppkey")
    return n.join(bad, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("faults"))


def publication_gate(spark, sf):
    """Controls by region, and whether it may be published."""
    n, r, s = (table(spark, sf, x) for x in ("nation", "region", "supplier"))
    j = r.join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    g = j.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("nations"), F.count("s_suppkey").alias("suppliers"), F.count_if(F.col("s_acctbal") < -900).alias("bad"))
    return g.withColumn("publish", (F.col("nations") >= 5) & (F.col("suppliers") > 0) & (F.col("bad") == 0))


def tie_break_cascade(spark, sf):
    """The supplier of a part: the only one, else the only cheap one, else the only near one, else to be decided."""
    li = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price"), F.min("l_linenumber").alias("line"))
    g = li.groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.min("l_suppkey").alias("any"), F.count_if(F.col("price") < 20000).alias("n2"), F.min(F.when(F.col("price") < 20000, F.col("l_suppkey"))).alias("s2"),
        F.count_if(F.col("line") == 1).alias("n3"), F.min(F.when(F.col("line") == 1, F.col("l_suppkey"))).alias("s3"),
    )
    pick = F.when(F.col("n") == 1, F.struct(F.col("any").alias("s"), F.lit("only").alias("via"))).when(F.col("n2") == 1, F.struct(F.col("s2").alias("s"), F.lit("cheap").alias("via"))).when(F.col("n3") == 1, F.struct(F.col("s3").alias("s"), F.lit("near").alias("via")))
    return g.withColumn("p", pick).select("l_partkey", F.col("p.s").alias("supplier"), F.coalesce("p.via", F.lit("to decide")).alias("via"))


def contact_precedence(spark, sf):
    c = table(spark, sf, "customer")
    own = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("65 "), F.col("c_custkey").cast("string")))
    chief = F.when(F.col("c_nationkey") % 4 != 0, F.concat(F.lit("41 "), F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", F.coalesce(own, chief).alias("phone"), F.when(own.isNotNull(), "captaincy").when(chief.isNotNull(), "governor").otherwise("none published").alias("reason"))


def attribution_states(spark, sf):
    """Four silences stay apart: absent, without a place, too far, undecided."""
    p = table(spark, sf, "part").withColumns({"bay": F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 25), "km": F.col("p_size") * 4})
    s = F.when(F.col("p_partkey") % 11 == 0, "absent").when(F.col("bay").isNull(), "no place").when(F.col("km") > 100, "too far").when(F.col("p_partkey") % 7 == 0, "undecided").otherwise("attributed")
    return p.groupBy(s.alias("state")).agg(F.count("*").alias("n"))


def change_cause_decomposition(spark, sf):
    """Why an order's priority class differs from last time's: new, gone, text, or both status and text."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority", "o_orderstatus", "o_orderkey")
    last = lambda y: o.where(F.col("y") == y).groupBy("o_custkey").agg(F.max_by(F.struct("o_orderpriority", "o_orderstatus"), "o_orderkey").alias("x"))
    j = last(1995).withColumnRenamed("x", "a").join(last(1996).withColumnRenamed("x", "b"), "o_custkey", "full")
    text, status = F.col("a.o_orderpriority") != F.col("b.o_orderpriority"), F.col("a.o_orderstatus") != F.col("b.o_orderstatus")
    cause = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(text & status, "both").when(text, "text").when(status, "status").otherwise("none")
    return j.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def list_count_consistency(spark, sf):
    """Orders whose lines are as many as their highest line number says."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("said"))
    return g.agg(F.count("*").alias("orders"), F.count_if(F.col("n") == F.col("said")).alias("consistent"))


def quote_in_source(spark, sf):
    """Benchmark items of three words or more that stand in documents as they are.

    What lies between blanks inside a quote lies between blanks in its source too: four such words in a row (one in
    quotes of fewer than six) bring quote and source together, and the whole quote decides.
    """
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"), F.split("text", " ").alias("w")).where("size(w) >= 3")
    q = q.withColumn("k", F.when(F.size("w") >= 6, 4).otherwise(1)).select("item_id", "q", "k", F.expr("xxhash64(k, slice(w, 2, k))").alias("h"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    w = d.select("doc_id", F.split("text", " ").alias("w"))
    at = lambda k: F.expr(f"CASE WHEN size(w) >= {k} THEN array_distinct(transform(sequence(1, size(w) - {k} + 1), i -> xxhash64({k}, slice(w, i, {k})))) END")
    met = w.select("doc_id", F.explode(at(4)).alias("h")).union(w.select("doc_id", F.explode(at(1)).alias("h"))).join(q, "h").select("doc_id", "item_id", "q").distinct()
    return met.join(d, "doc_id").where(F.contains("text", "q")).groupBy("item_id").agg(F.count("*").alias("documents"))


def declared_state_audit(spark, sf):
    d = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(d, "doc_id", "left")
    s = F.when(F.col("quality").isNull(), "undeclared").when((F.col("quality") == 1) & (F.col("toxic") == 1), "contradictory").when(F.col("n_chars") < 300, "too short").otherwise("holds")
    return j.groupBy(s.alias("state")).agg(F.count("*").alias("n"))


def expectations(spark, sf):
    """Unique keys, references both ways and closed vocabularies of the tables: how often each is broken."""
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    checks = [
        ("orders.key unique", o.groupBy("o_orderkey").agg(F.count("*").alias("k")).where("k > 1")),
        ("orders.customer known", o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("customer has orders", c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("customer.nation known", c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")),
        ("orders.status closed", o.where(~F.col("o_orderstatus").isin("F", "O"))),
    ]
    out = None
    for name, broken in checks:
        row = broken.agg(F.count("*").alias("broken")).select(F.lit(name).alias("name"), "broken")
        out = row if out is None else out.union(row)
    return out


QUERIES = {
    "lookup_with_default": (lookup_with_default, "SELECT o_orderkey AS id, coalesce(n_name, 'Desconocida') AS office FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40"),
    "two_role_lookup": (two_role_lookup, "SELECT o_orderkey, concat_ws(' > ', a.n_name, b.n_name) AS route FROM orders JOIN nation a ON a.n_nationkey = o_custkey % 25 LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 25 AND o_orderkey % 3 <> 0"),
    "resolver_coalesce": (resolver_coalesce, "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN n_name WHEN c_nationkey % 3 = 0 THEN lower(n_name) END AS office, CASE WHEN c_nationkey % 2 = 0 THEN 'first' WHEN c_nationkey % 3 = 0 THEN 'second' END AS source FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "anti_unknown_ids": (anti_unknown_ids, "SELECT DISTINCT o_custkey % 40 AS bay FROM orders WHERE o_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)"),
    "drift_in_route": (drift_in_route, "SELECT o_custkey % 40 AS bay, count(*) AS n FROM orders WHERE o_custkey % 40 NOT IN (SELECT n_nationkey FROM nation) AND o_custkey % 7 IN (SELECT r_regionkey FROM region) GROUP BY 1"),
    "bridge_any_match": (bridge_any_match, "SELECT n_nationkey::BIGINT AS bay FROM nation WHERE n_regionkey IN (1, 3) OR (n_nationkey * 3) % 7 IN (1, 3)"),
    "catalog_drift": (catalog_drift, "WITH m AS (SELECT id, string_agg(DISTINCT src, '' ORDER BY src) AS held FROM (SELECT c_custkey AS id, 'a' AS src FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT o_custkey, 'b' FROM orders UNION ALL SELECT s_suppkey, 'c' FROM supplier) GROUP BY 1) SELECT held, count(*) AS n, min(id) AS first, CASE WHEN held = 'abc' THEN 'same' ELSE 'drift' END AS state FROM m GROUP BY 1"),
    "merge_origins": (merge_origins, "WITH u AS (SELECT c_nationkey AS id, 'customer' AS src, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS name, c_custkey AS ord FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_name, s_suppkey + 10000000 FROM supplier) SELECT id, string_agg(DISTINCT src, '+' ORDER BY src) AS origins, arg_min(name, ord) FILTER (WHERE name IS NOT NULL) AS name FROM u GROUP BY 1"),
    "source_agreement": (source_agreement, "WITH b AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 1 WHEN n_chars % 5 <> 0 THEN 0 END AS b, true AS in_b FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, quality AS a, true AS in_a FROM labels) SELECT CASE WHEN in_a IS NULL OR in_b IS NULL THEN 'missing' WHEN a IS NULL OR b IS NULL THEN 'null' WHEN a = b THEN 'agree' ELSE 'disagree' END AS state, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1"),
    "two_key_match": (two_key_match, "WITH s AS (SELECT s_suppkey, s_name, s_suppkey % 97 AS p FROM supplier), o AS (SELECT p, count(*) AS n, min(s_suppkey) AS x FROM s GROUP BY 1) SELECT c_custkey, coalesce(s.s_suppkey, CASE WHEN n = 1 THEN x END) AS supplier, CASE WHEN s.s_suppkey IS NOT NULL THEN 'name' WHEN n = 1 THEN 'phone' WHEN n > 1 THEN 'phone shared' ELSE 'unknown' END AS how FROM customer LEFT JOIN s ON s_name = 'Supplier#' || lpad((c_custkey % 2000)::VARCHAR, 9, '0') LEFT JOIN o ON o.p = c_custkey % 97"),
    "name_candidates": (name_candidates, """WITH k AS (SELECT p_partkey::BIGINT AS k, p_name || ' ' || (p_partkey % 150) AS name, p_name FROM part), u AS (SELECT upper(name) AS key, count(*) AS n FROM k GROUP BY 1),
      a AS (SELECT s_suppkey::BIGINT AS id, upper(CASE s_suppkey % 4 WHEN 0 THEN name WHEN 1 THEN 'Laguna ' || name WHEN 2 THEN 'Lago ' || p_name || 'es' ELSE name || ' qqqq' END) AS key FROM supplier JOIN k ON k.k = s_suppkey * 2),
      h AS (SELECT a.id, a.key, x.n AS whole, y.n AS part FROM a LEFT JOIN u x ON x.key = a.key LEFT JOIN u y ON y.key = regexp_replace(a.key, '^[^ ]+ ', '')),
      t AS (SELECT id, key, coalesce(whole, part, 0) AS hits, CASE WHEN whole IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'bare' END AS via, list_transform(list_filter(string_split(key, ' '), lambda w: len(w) > 3 AND w NOT IN ('LAGO', 'LAGUNA', 'RIO')), lambda w: w[1:6]) AS w FROM h),
      c AS (SELECT id, sum(n)::BIGINT AS n FROM t JOIN u ON hits = 0 AND len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(u.key, x))) = 0 GROUP BY 1)
      SELECT id, CASE WHEN hits = 1 THEN 'SI' WHEN hits > 1 THEN 'DUDOSO' ELSE 'NO' END AS status, via, hits, coalesce(n, 0)::BIGINT AS candidates FROM t LEFT JOIN c USING (id)"""),
    "name_match_status": (name_match_status, f"WITH k AS (SELECT {norm_sql('p_type')} AS key, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'SI' WHEN n <= 12 THEN 'DUDOSO' ELSE 'NO' END AS status, sum(n)::BIGINT AS parts FROM k GROUP BY 1"),
    "token_mention_join": (token_mention_join, r"""WITH b AS (SELECT item_id, i, w FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS l FROM benchmark), LATERAL (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i)), f AS (SELECT item_id, w, min(i) AS i FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(i)) <= 3),
      d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents), k AS (SELECT item_id, doc_id, count(*) AS k FROM f JOIN d USING (w) GROUP BY 1, 2), n AS (SELECT item_id, count(*) AS n FROM f GROUP BY 1)
      SELECT item_id, count(*) AS documents FROM k JOIN n USING (item_id) WHERE k = n GROUP BY 1"""),
    "shared_vertex_pairs": (shared_vertex_pairs, "WITH v AS (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM v x JOIN v y ON x.l_partkey = y.l_partkey AND x.l_linenumber = y.l_linenumber AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2"),
    "lateral_metrics": (lateral_metrics, "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS big, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "controls_by_group": (controls_by_group, "SELECT n_name, count(s_suppkey) AS faults FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal < 0 GROUP BY 1"),
    "publication_gate": (publication_gate, "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(s_suppkey) AS suppliers, count(*) FILTER (WHERE s_acctbal < -900) AS bad, count(DISTINCT n_nationkey) >= 5 AND count(s_suppkey) > 0 AND count(*) FILTER (WHERE s_acctbal < -900) = 0 AS publish FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1"),
    "tie_break_cascade": (tie_break_cascade, "WITH l AS (SELECT l_partkey, l_suppkey AS s, min(l_extendedprice) AS p, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2), g AS (SELECT l_partkey, count(*) AS n, min(s) AS s1, count(*) FILTER (WHERE p < 20000) AS n2, min(s) FILTER (WHERE p < 20000) AS s2, count(*) FILTER (WHERE k = 1) AS n3, min(s) FILTER (WHERE k = 1) AS s3 FROM l GROUP BY 1) SELECT l_partkey, CASE WHEN n = 1 THEN s1 WHEN n2 = 1 THEN s2 WHEN n3 = 1 THEN s3 END AS supplier, CASE WHEN n = 1 THEN 'only' WHEN n2 = 1 THEN 'cheap' WHEN n3 = 1 THEN 'near' ELSE 'to decide' END AS via FROM g"),
    "contact_precedence": (contact_precedence, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '65 ' || c_custkey WHEN c_nationkey % 4 <> 0 THEN '41 ' || c_nationkey END AS phone, CASE WHEN c_custkey % 3 = 0 THEN 'captaincy' WHEN c_nationkey % 4 <> 0 THEN 'governor' ELSE 'none published' END AS reason FROM customer"),
    "attribution_states": (attribution_states, "SELECT CASE WHEN p_partkey % 11 = 0 THEN 'absent' WHEN p_partkey % 4 = 0 THEN 'no place' WHEN p_size * 4 > 100 THEN 'too far' WHEN p_partkey % 7 = 0 THEN 'undecided' ELSE 'attributed' END AS state, count(*) AS n FROM part GROUP BY 1"),
    "change_cause_decomposition": (change_cause_decomposition, "WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, arg_max(o_orderpriority, o_orderkey) AS p, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2), a AS (SELECT * FROM o WHERE y = 1995), b AS (SELECT * FROM o WHERE y = 1996) SELECT CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'gone' WHEN a.p <> b.p AND a.s <> b.s THEN 'both' WHEN a.p <> b.p THEN 'text' WHEN a.s <> b.s THEN 'status' ELSE 'none' END AS cause, count(*) AS n FROM a FULL JOIN b ON a.o_custkey = b.o_custkey GROUP BY 1"),
    "list_count_consistency": (list_count_consistency, "WITH g AS (SELECT count(*) AS n, max(l_linenumber) AS said FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS orders, count(*) FILTER (WHERE n = said) AS consistent FROM g"),
    "quote_in_source": (quote_in_source, "SELECT item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(string_split(b.text, ' ')) >= 3 GROUP BY 1"),
    "declared_state_audit": (declared_state_audit, "SELECT CASE WHEN quality IS NULL THEN 'undeclared' WHEN quality = 1 AND toxic = 1 THEN 'contradictory' WHEN n_chars < 300 THEN 'too short' ELSE 'holds' END AS state, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "expectations": (expectations, "SELECT 'orders.key unique' AS name, count(*) AS broken FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orders.customer known', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer has orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'customer.nation known', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'orders.status closed', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
}
