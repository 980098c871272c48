"""Where queries bind the operators to the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: str) -> Column:
    """A place for a key: its latitude."""
    return F.lit(-18.0) - (F.col(key).cast("bigint") * 7919 % 3800) / F.lit(100.0)


def lng(key: str) -> Column:
    return F.lit(-76.0) + (F.col(key).cast("bigint") * 104729 % 1000) / F.lit(100.0)


def lat_sql(key: str) -> str:
    return f"(-18.0::DOUBLE - ((CAST({key} AS BIGINT) * 7919) % 3800) / 100.0::DOUBLE)"


def lng_sql(key: str) -> str:
    return f"(-76.0::DOUBLE + ((CAST({key} AS BIGINT) * 104729) % 1000) / 100.0::DOUBLE)"


def haversine_sql(a: str, b: str, radius: float = 6371.0) -> str:
    """Distance of ``a.lat``, ``a.lng`` and ``b.lat``, ``b.lng``."""
    h = f"(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lng - {a}.lng) / 2), 2))"
    return f"(2 * {radius}::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def round_sql(x: str, places: int) -> str:
    k = f"{10**places}.0::DOUBLE"
    return f"(floor(({x}) * {k} + 0.5::DOUBLE) / {k})"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restriction feed made of orders: five kinds of free text, bays 0 to 24, monthly captures."""
    o = table(spark, sf_dir, "orders")
    kind = F.substring("o_orderpriority", 1, 1)
    n1, n2 = (10 + F.col("o_custkey") % 90).cast("string"), (1 + F.col("o_custkey") % 50).cast("string")
    text = (
        F.when(kind == "1", F.concat(F.lit("Se establece condición de mal tiempo, puerto cerrado para EE.MM. de "), n1, F.lit(" AB dentro de la bahía y "), n2, F.lit(" TRG fuera")))
        .when(kind == "2", F.concat(F.lit(" TIEMPO VARIABLE, EMBARCACIONES MENORES DE "), n2, F.lit(" A/B FUERA DE LA BAHÍA ")))
        .when(kind == "3", F.lit("TEMPORAL EN LA COSTA; TODO TIPO DE NAVES"))
        .when(kind == "4", F.lit("RESTRICCIÓN PARA EMBARCACIONES MENORES DENTRO Y FUERA DEL PUERTO"))
    )
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("bay"), F.when(F.col("o_orderstatus") == "F", "TODOS ").otherwise("PARCIAL").alias("kind"),
        text.alias("observation"), F.when(F.col("o_custkey") % 3 == 0, "MAL TIEMPO").when(F.col("o_custkey") % 3 == 1, "variable").alias("motive"),
        F.when(F.col("o_custkey") % 4 == 0, "NAVE MAYOR").when(F.col("o_custkey") % 4 == 1, "nave menor").when(F.col("o_custkey") % 4 == 2, "TODO").alias("receives"),
        F.when(F.col("o_orderkey") % 3 == 0, "Dentro").when(F.col("o_orderkey") % 3 == 1, "FUERA").alias("area"),
        F.date_trunc("month", "o_orderdate").alias("capture"), (F.col("o_custkey") % 120).alias("tonnage"),
    )


FEED_SQL = """
feed AS (SELECT o_orderkey AS id, o_custkey % 25 AS bay, CASE o_orderstatus WHEN 'F' THEN 'TODOS ' ELSE 'PARCIAL' END AS kind,
  CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN 'Se establece condición de mal tiempo, puerto cerrado para EE.MM. de ' || (10 + o_custkey % 90) || ' AB dentro de la bahía y ' || (1 + o_custkey % 50) || ' TRG fuera'
    WHEN '2' THEN ' TIEMPO VARIABLE, EMBARCACIONES MENORES DE ' || (1 + o_custkey % 50) || ' A/B FUERA DE LA BAHÍA '
    WHEN '3' THEN 'TEMPORAL EN LA COSTA; TODO TIPO DE NAVES'
    WHEN '4' THEN 'RESTRICCIÓN PARA EMBARCACIONES MENORES DENTRO Y FUERA DEL PUERTO' END AS observation,
  CASE o_custkey % 3 WHEN 0 THEN 'MAL TIEMPO' WHEN 1 THEN 'variable' END AS motive,
  CASE o_custkey % 4 WHEN 0 THEN 'NAVE MAYOR' WHEN 1 THEN 'nave menor' WHEN 2 THEN 'TODO' END AS receives,
  CASE o_orderkey % 3 WHEN 0 THEN 'Dentro' WHEN 1 THEN 'FUERA' END AS area,
  date_trunc('month', o_orderdate) AS capture, o_custkey % 120 AS tonnage FROM orders)
"""
