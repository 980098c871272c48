"""Normalisation of names and free text, and what is read from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with accents and those without.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
# Twice-encoded letters as they arrive, and the letter meant.
MOJIBAKE = (("Ã[“”\"]", "O"), ("Ã‰", "E"), ("Ãš", "U"), ("Ã[‘’]", "N"), ("Ã\u008d", "I"))
# Thresholds in gross tonnage or TRG, from the most specific wording to the least.
THRESHOLDS = (
    r"EMBARCACIONES\s+MENORES?\s+DE\s+(\d+)\s*A/?\.?B",
    r"EMBARCACIONES\s+MENORES?\s+DE\s+(\d+)\s+ARQUEO\s+BRUTO",
    r"EMBARCACIONES\s+MENORES?\s+A\s+(\d+)\s*A\.?B",
    r"NAVES?\s+MENORES?\s+DE\s+(\d+)\s*A\.?B",
    r"EE\.?MM\.?\s*(?:(?:DE|A)\s+)?(\d+)\s*A\.?B",
    r"EE\.?MM\.?\s*-\s*(\d+)\s*A\.?B",
    r"EE\.?MM\.?\s*<\s*(\d+)\s*A\.?B",
    r"EE\.?MM\.?\s*(?:(?:DE|A)\s+)?(\d+)\s*TRG",
    r"NAVES?\s+MENORES?\s+DE\s+(\d+)\s+ARQUEO\s+BRUTO",
    r"NAVE\s+MENOR\s+A\s+(\d+)\s*TRG",
    r"(\d+)\s*(?:A\.?B|TRG)\b",
)
# Thresholds inside and outside of a bay, and what closes it for all.
INSIDE = (r"(\d+)\s*(?:A\.?B\.?|TRG)\s+(?:[A-Z\s]*?)DENTRO", r"DENTRO[^.;]*?(\d+)\s*(?:A\.?B|TRG)")
OUTSIDE = (r"(\d+)\s*(?:A\.?B\.?|TRG)\s+(?:[A-Z\s]*?)FUERA", r"FUERA[^.;]*?(\d+)\s*(?:A\.?B|TRG)")
ALL_SHIPS = r"TODO\s+TIPO\s+DE\s+NAVES"


def normalize(text: Column) -> Column:
    """Upper case without accents or outer blanks; null is empty."""
    return F.upper(F.trim(F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("SS")), ACCENTED, PLAIN)))


def repair(text: Column) -> Column:
    """Twice-encoded letters mended."""
    return reduce(lambda t, p: F.regexp_replace(t, *p), MOJIBAKE, text)


def first_number(text: Column, patterns: tuple[str, ...]) -> Column:
    """The number in the first pattern that matches. What does not match is an empty text, which is no number."""
    return F.coalesce(*(F.regexp_extract(text, p, 1).try_cast("bigint") for p in patterns))


def condition(observation: Column, motive: Column) -> Column:
    """TEMPORAL before MAL_TIEMPO before VARIABLE before OTRO, in normalised texts."""
    said = lambda w: observation.contains(w) | motive.contains(w)
    return F.when(said("TEMPORAL"), "TEMPORAL").when(said("MAL TIEMPO"), "MAL_TIEMPO").when(said("VARIABLE"), "VARIABLE").otherwise("OTRO")


def legible_condition(observation: Column, motive: Column) -> Column:
    """The condition as shown, or the motive in sentence case."""
    t, m = F.upper(F.coalesce(observation, F.lit(""))), F.trim(F.coalesce(motive, F.lit("")))
    return (
        F.when(t.contains("TEMPORAL"), "Temporal").when(t.contains("MAL TIEMPO"), "Mal Tiempo").when(t.contains("TIEMPO VARIABLE"), "Tiempo Variable")
        .when(t.contains("CERRADO"), "Puerto Cerrado").when(m != "", F.concat(F.upper(F.substring(m, 1, 1)), F.lower(F.substring(m, 2, 1 << 30))))
    )


def area(text: Column) -> Column:
    """DENTRO, FUERA, or both, which is also what says neither."""
    a = normalize(text)
    return F.when(a.contains("DENTRO") & ~a.contains("FUERA"), "DENTRO").when(a.contains("FUERA") & ~a.contains("DENTRO"), "FUERA").otherwise("DENTRO_Y_FUERA")


def with_thresholds(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``inside``, ``outside``, ``total`` of a normalised text: two thresholds where it has both, else one for both. Each pattern is tried once a row."""
    t = F.col(text)
    found = rows.withColumns({"_in": first_number(t, INSIDE), "_out": first_number(t, OUTSIDE), "_one": first_number(t, THRESHOLDS), "total": t.rlike(ALL_SHIPS)})
    apart = F.col("_in").isNotNull() & F.col("_out").isNotNull()
    return found.withColumns({
        "inside": F.when(~F.col("total"), F.when(apart, F.col("_in")).otherwise(F.col("_one"))),
        "outside": F.when(~F.col("total"), F.when(apart, F.col("_out")).otherwise(F.col("_one"))),
    }).drop("_in", "_out", "_one")
