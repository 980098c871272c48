"""Names against a list of names: whole, without the noun of their kind, and alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.functions.text import normalize

# Nouns of a kind of water that tell no name.
NOUNS = ("LAGO", "LAGUNA", "RIO")
_GRAM, _PREFIX = 4, 6


def name_matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``id``, ``status``, ``via``, ``hits``, ``candidates`` of names ``asked`` (``id``, ``name``) for in those ``known`` (``name``, repeats count).

    A name is looked for as it is (``exact``), then without its first word (``bare``): one hit is SI, several are
    DUDOSO, none is NO. For NO the candidates are the known names that hold the first six letters of each of its words
    of four letters or more that are no noun of a kind; they are only counted, never taken. A null name has no row.

    Candidates meet through the rarest of the words' first four letters among all known names, so no name meets
    the whole list unless it is written all over it.
    """
    names = known.where("name is not null").groupBy(normalize(F.col("name")).alias("key")).agg(F.count("*").alias("n"))
    words = F.split("key", " ")
    a = asked.where("name is not null").select("id", normalize(F.col("name")).alias("key"))
    a = a.withColumn("bare", F.when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise(F.col("key")))
    a = a.join(names.withColumnRenamed("n", "whole"), "key", "left").join(names.select(F.col("key").alias("bare"), F.col("n").alias("part")), "bare", "left")
    hits = F.coalesce("whole", "part", F.lit(0).cast("long"))
    a = a.select("id", "key", hits.alias("hits"), F.when(F.col("whole").isNotNull(), "exact").when(F.col("part").isNotNull(), "bare").alias("via"))

    told = F.filter(words, lambda w: ~w.isin(*NOUNS) & (F.length(w) >= _GRAM))
    starts = a.where("hits = 0").select("id", F.transform(told, lambda w: F.substring(w, 1, _PREFIX)).alias("starts")).where("size(starts) > 0")
    grams = names.where(F.length("key") >= _GRAM).withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - (_GRAM - 1)), lambda i: F.substring("key", i, F.lit(_GRAM))))))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    rare = starts.select("id", "starts", F.explode(F.transform("starts", lambda w: F.substring(w, 1, _GRAM))).alias("gram")).join(often, "gram", "left")
    rare = rare.groupBy("id").agg(F.min(F.struct(F.coalesce("often", F.lit(0).cast("long")), "gram")).alias("x"), F.any_value("starts").alias("starts")).select("id", "starts", "x.gram")
    alike = rare.join(grams, "gram").where(F.forall("starts", lambda w: F.contains(F.col("key"), w)))
    alike = alike.groupBy("id").agg(F.sum("n").alias("candidates"))
    status = F.when(F.col("hits") == 1, "SI").when(F.col("hits") > 1, "DUDOSO").otherwise("NO")
    return a.join(alike, "id", "left").select("id", status.alias("status"), "via", "hits", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))
