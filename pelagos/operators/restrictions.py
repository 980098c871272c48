"""Restrictions: read from text, judged for a vessel, ordered along a route and folded into one verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.functions import text as T

#: Verdicts in order: free, caution, forbidden.
RANKS = ("Q", "U", "UV")


def verdict(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANKS)), rank.cast("int") + 1)


def read_once(rows: DataFrame, text: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``read`` adds to a table of their different texts: notices repeat from capture to capture, and reading them is what costs."""
    texts = rows.select(F.col(text).alias("_read")).distinct()
    found = read(texts.withColumn(text, F.col("_read"))).drop(text)
    return rows.join(found, F.col(text).eqNullSafe(F.col("_read"))).drop("_read")


def normalized(feed: DataFrame) -> DataFrame:
    """``feed`` with what its texts say: condition, whom it affects, thresholds, area."""
    out = read_once(feed, "observation", lambda t: T.with_thresholds(t.withColumn("obs", T.normalize(F.col("observation"))), "obs"))
    out = out.withColumns({"mot": T.normalize(F.col("motive")), "who": T.normalize(F.col("receives"))})
    ships = F.col("obs").contains("TODO TIPO DE NAVES")
    return out.withColumns({
        "condition": T.condition(F.col("obs"), F.col("mot")),
        "minors": F.col("who").contains("MENOR") | F.col("who").contains("TODO") | ships | F.col("obs").contains("TODO TIPO DE EMBARCACIONES"),
        "majors": F.col("who").contains("MAYOR") | F.col("who").contains("TODO") | ships, "zone": T.area(F.col("area")),
    }).drop("obs", "mot", "who")


def rules(vessel: Column) -> Column:
    """All rules that fire, by priority: structs ``priority``, ``rank``, ``rule``. ``vessel`` is its tonnage, null if unknown."""
    bad, changing = F.col("condition") == "MAL_TIEMPO", F.col("condition") == "VARIABLE"
    limit, under = F.col("outside") > 0, vessel < F.col("outside")
    # Priorities and levels of the seven rules.
    table = (
        (10, 2, "temporal", F.col("condition") == "TEMPORAL"),
        (9, 2, "total", F.col("total")),
        (8, 2, "bad-weather", bad & F.col("outside").isNull() & F.col("minors")),
        (7, 2, "bad-weather-limit", bad & limit & vessel.isNotNull() & under),
        (6, 1, "variable-limit", changing & limit & vessel.isNotNull() & under),
        (5, 1, "variable", changing & F.col("outside").isNull() & F.col("minors")),
        (4, 1, "unknown-tonnage", limit & vessel.isNull()),
    )
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(r).alias("rank"), F.lit(n).alias("rule"))) for p, r, n, c in table)))


def judged(feed: DataFrame, vessel: Column) -> DataFrame:
    """``normalized`` rows with ``rank``, ``rule`` and ``state``: of the rules that fire the worst level wins, then the higher priority."""
    fired = normalized(feed).withColumn("fired", rules(vessel))
    best = F.expr("array_max(transform(fired, x -> struct(x.rank, x.priority, x.rule)))")
    out = fired.withColumn("best", best).withColumns({"rank": F.coalesce("best.rank", F.lit(0)), "rule": F.col("best.rule")})
    state = (
        F.when(F.col("best").isNull(), "not_affected").when(F.col("rank") == 2, "blocks")
        .when(vessel.isNull() & F.col("outside").isNotNull(), "no_tonnage").otherwise("caution")
    )
    return out.withColumn("state", state).drop("best", "fired")


def along_route(rows: DataFrame, route: str, order: list[str]) -> DataFrame:
    """Per route and row in order: ``nth``, the worst rank up to it, whether it raises that, and the row before the first block."""
    w = W.Window.partitionBy(route).orderBy(*order)
    before = w.rowsBetween(W.Window.unboundedPreceding, -1)
    out = rows.withColumns({"nth": F.row_number().over(w), "worst_before": F.coalesce(F.max("rank").over(before), F.lit(0))})
    return out.withColumns({
        "raises": F.col("rank") > F.col("worst_before"),
        "worst": F.greatest("rank", "worst_before"),
        "first_block": (F.col("rank") == 2) & (F.col("worst_before") < 2),
    })


def preferred(rows: DataFrame, key: str, matches: Column, order: list[str], columns: list[str]) -> DataFrame:
    """Of each key's rows the first that matches, else the first."""
    best = F.struct((~F.coalesce(matches, F.lit(False))).cast("int").alias("_m"), *order)
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), best).alias("_r")).select(key, "_r.*")
