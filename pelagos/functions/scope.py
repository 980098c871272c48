"""Whom a closure reaches, read from its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagos.functions.text import normalize

# What says that a port closes, what ends the phrase of whom it reaches, and the words of classes and limits.
CLOSES = r"\bCERRAD[OA]S?\b|\bCIERRES?\b|\bCERRAR\w*\b|\bCIERRAN?\b|\bCLAUSUR\w*\b|\bTRAFICO\s+SUSPENDIDO\b|\bSE\s+SUSPENDE\s+EL\s+TRAFICO\b|\bPROHIBICION\s+DE\s+ZARPE\b"
ENDS = r"\b(?:DENTRO|FUERA|POR|SE|CON|HACIA|DESDE|ENTRE|EXCEPTO|CUANDO|QUE|RES|EN)\b"
ALL_OF_CLASS = r"TODO?A?S?\s+TIPOS?\s+(?:DE\s+)?(?:NAVES|EMBARCACIONES)\s+(MENORES?|MAYORES?)"
ALL = r"TODO?A?S?\s+TIPOS?\s+(?:DE\s+)?(?:NAVES|EMBARCACIONES)|NAVES\s+Y\s+EMBARCACIONES"
MINOR = r"\bMENOR(?:ES)?\b|\bEE\s*MM\b"
MAJOR = r"\bMAYOR(?:ES)?\b|\bSUPERIOR(?:ES)?\b"
LIMIT = r"\b\d+\s*(?:A\s?B|ARQUEO(?:\s+BRUTO)?|TRG)\b"


def plain(text: Column) -> Column:
    """Upper case without accents, entities decoded, punctuation as blanks, single blanks."""
    t = normalize(text)
    for entity, mark in (("&LT;", " "), ("&GT;", " "), ("&AMP;", " "), ("&NBSP;", " ")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^A-Z0-9]+", " "), r"\s+", " "))


def parts(text: Column) -> Column:
    """Structs ``kind`` (total, majors, minors, limit), ``limit``, ``unit``: all that the text reaches.

    A phrase begins at PARA where the text before says that the port closes, and ends at the next PARA or at a word
    that leads on. In it, "all kinds of minor craft" is one class; a class takes the first limit before the next
    class; a class named twice in a row is one; a limit before any class stands alone.
    """
    pieces = F.split(F.concat(F.lit(" "), plain(text), F.lit(" ")), r"\bPARA\b")
    said = F.transform(pieces, lambda x, i: F.struct(F.array_join(F.slice(pieces, 1, i), " ").alias("before"), F.regexp_replace(x, f"(?:{ENDS}).*$", "").alias("says")))
    phrases = F.transform(F.filter(F.slice(said, 2, 1 << 20), lambda x: x["before"].rlike(CLOSES)), lambda x: x["says"])
    return F.flatten(F.transform(phrases, _phrase))


def _phrase(says: Column) -> Column:
    whole = F.transform(F.regexp_extract_all(says, F.lit(ALL_OF_CLASS), F.lit(1)), lambda x: F.when(x.startswith("MAYOR"), "majors").otherwise("minors"))
    none = F.struct(F.lit(None).cast("string").alias("open"), F.lit(False).alias("taken"), F.array().cast("array<struct<kind:string,limit:bigint,unit:string>>").alias("out"))
    words = F.regexp_extract_all(F.regexp_replace(says, ALL_OF_CLASS, " "), F.lit(f"{ALL}|{MINOR}|{MAJOR}|{LIMIT}"), F.lit(0))
    part = lambda k, n=None, u=None: F.struct(k.alias("kind"), (n if n is not None else F.lit(None).cast("bigint")).alias("limit"), (u if u is not None else F.lit(None).cast("string")).alias("unit"))

    def step(s: Column, w: Column) -> Column:
        number = w.rlike(r"^\d")
        limit = part(F.lit("limit"), F.regexp_extract(w, r"^(\d+)", 1).try_cast("bigint"), F.when(w.contains("TRG"), "TRG").otherwise("AB"))
        kind = F.when(w.rlike(f"^(?:{MINOR})"), "minors").when(w.rlike(f"^(?:{MAJOR})"), "majors").otherwise("total")
        left = F.when(s["open"].isNotNull() & ~s["taken"], F.array_append(s["out"], part(s["open"]))).otherwise(s["out"])
        state = lambda o, t, x: F.struct(o.alias("open"), t.alias("taken"), x.alias("out"))
        return (
            F.when(number & s["open"].isNotNull() & s["taken"], s)
            .when(number, state(s["open"], s["open"].isNotNull(), F.array_append(s["out"], limit)))
            .when(s["open"].eqNullSafe(kind), s).otherwise(state(kind, F.lit(False), left))
        )

    last = lambda s: F.when(s["open"].isNotNull() & ~s["taken"], F.array_append(s["out"], part(s["open"]))).otherwise(s["out"])
    return F.concat(F.transform(whole, lambda k: part(k)), F.aggregate(words, none, step, last))


def union(found: Column) -> Column:
    """One struct ``kind``, ``limit``, ``unit`` for all parts, folded in their order: null without parts, ``unsummed`` from the first pair on that has no sum.

    Total takes in all, majors and minors are total, minors take in a limit, limits of one unit are the higher one;
    units are not converted, and majors have no sum with a limit. Majors alone are no result either.
    """
    struct = lambda k, n=None, u=None: F.struct(k.alias("kind"), (F.lit(None).cast("bigint") if n is None else n).alias("limit"), (F.lit(None).cast("string") if u is None else u).alias("unit"))
    none, total, unsummed = (struct(F.lit(k).cast("string")) for k in (None, "total", "unsummed"))

    def add(s: Column, x: Column) -> Column:
        either = lambda k: (s["kind"] == k) | (x["kind"] == k)
        return (
            F.when(s["kind"].isNull(), x).when(s["kind"] == "unsummed", s).when(either("total"), total)
            .when((s["kind"] == "limit") & (x["kind"] == "limit"), F.when(s["unit"] != x["unit"], unsummed).when(s["limit"] >= x["limit"], s).otherwise(x))
            .when(s["kind"] == x["kind"], s).when(either("majors") & either("minors"), total)
            .when(either("minors") & either("limit"), F.when(s["kind"] == "minors", s).otherwise(x)).otherwise(unsummed)
        )

    return F.aggregate(found, none, add, lambda s: F.when(s["kind"] == "majors", unsummed).otherwise(s))
