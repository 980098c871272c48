"""Ways over many tiles of cells: costs between the portals of each tile once, then searches that only see portals."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.sources.scratch import written

_FAR, _STEPS = 1 << 60, 20
_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _priced(rows: pd.DataFrame, tile: int) -> np.ndarray:
    """Prices of a tile's cells with a margin of one; no price where there is no cell."""
    w = np.full((tile + 2, tile + 2), -1, np.int64)
    w[rows["r"].to_numpy() % tile + 1, rows["c"].to_numpy() % tile + 1] = rows["w"].to_numpy()
    return w


def _relaxed(known: np.ndarray, w: np.ndarray, through: np.ndarray) -> np.ndarray:
    """Least costs in a tile from each of several sources: layers of ``known``, relaxed until none changes.

    A value is cost, steps and a last bit that is set where no portal but the source was passed on the best way;
    ``through`` marks the cells of each layer that clear it. Steps make each way longer than its parts.
    """
    t = w.shape[0] - 2
    inner = (slice(None), slice(1, -1), slice(1, -1))
    price = np.where(w >= 0, (w << (_STEPS + 1)) + 2, _FAR)[1:-1, 1:-1]
    while True:
        leave = np.where(through, known & ~1, known)
        near = reduce(np.minimum, (leave[:, 1 + i : 1 + i + t, 1 + j : 1 + j + t] for i, j in _AROUND))
        after = np.minimum(known[inner], near + price)
        if np.array_equal(after, known[inner]):
            return known
        known[inner] = after


def _portals(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a tile's cells on its rim."""
    rim = np.zeros(w.shape, bool)
    rim[1:-1, 1:-1] = True
    rim[2:-2, 2:-2] = False
    return np.nonzero(rim & (w >= 0))


def _ways(tile: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(rows["tr"].iloc[0]), int(rows["tc"].iloc[0])
        w = _priced(rows, tile)
        r, c = _portals(w)
        n = np.arange(len(r))
        known = np.full((len(r), *w.shape), _FAR)
        known[n, r, c] = 1
        through = np.zeros(known.shape, bool)
        through[:, r, c] = True
        through[n, r, c] = False
        found = _relaxed(known, w, through)[:, r, c]
        a, b = np.nonzero((found < _FAR) & (found & 1 == 1) & (n[:, None] != n))
        at = lambda x, t, k: t * tile + x[k] - 1
        out = {"tr": tr, "tc": tc, "ar": at(r, tr, a), "ac": at(c, tc, a), "br": at(r, tr, b), "bc": at(c, tc, b), "cost": found[a, b] >> (_STEPS + 1)}
        return pd.DataFrame(out)

    return run


def _tile(x: str, tile: int) -> Column:
    return F.floor(F.col(x) / tile)


def portal_ways(cells: DataFrame, tile: int = 32) -> DataFrame:
    """``tr``, ``tc``, ``ar``, ``ac``, ``br``, ``bc``, ``cost``: the cheapest way within a tile between two cells of its rim.

    ``cells``: ``r``, ``c``, ``w`` >= 0, the price of entering. Ways that pass another cell of the rim at no greater
    cost are left out: they are made of others. Written in the order of tiles, so that a search reads those that it meets.
    Costs within a tile must stay under 2**38.
    """
    at = cells.select(F.col("r").cast("long"), F.col("c").cast("long"), F.col("w").cast("long"), _tile("r", tile).alias("tr"), _tile("c", tile).alias("tc"))
    ways = at.groupBy("tr", "tc").applyInPandas(_ways(tile), "tr long, tc long, ar long, ac long, br long, bc long, cost long")
    return written(ways.repartitionByRange("tr", "tc").sortWithinPartitions("tr", "tc"), "ways")


def _ends(tile: int):
    """Costs between one end of a request and the rim of its tile, and the start's cost to a goal in the same tile."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        w = _priced(rows, tile)
        r, c = _portals(w)
        y, x = int(head["er"]) % tile + 1, int(head["ec"]) % tile + 1
        known = np.full((1, *w.shape), _FAR)
        known[0, y, x] = 0
        cost = _relaxed(known, w, np.zeros(known.shape, bool))[0] >> (_STEPS + 1)
        if head["goal"]:  # the same way back leaves out the price of its first cell, and pays that of the goal
            cost = np.where(cost < _FAR >> (_STEPS + 1), cost - w + w[y, x], cost)
        elif (int(head["or"]) // tile, int(head["oc"]) // tile) == (int(head["tr"]), int(head["tc"])):
            r, c = np.append(r, int(head["or"]) % tile + 1), np.append(c, int(head["oc"]) % tile + 1)
        rim = np.arange(len(r)) < len(_portals(w)[0])
        out = pd.DataFrame({"id": head["id"], "goal": head["goal"], "rim": rim, "r": head["tr"] * tile + r - 1, "c": head["tc"] * tile + c - 1, "cost": cost[r, c]})
        return out[out["cost"] < _FAR >> (_STEPS + 1)]

    return run


def _closed(ways: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
    """The rim of one tile: what its cells cost from those that are offered."""
    onward: dict[tuple, list] = {}
    for ar, ac, br, bc, x in ways[["ar", "ac", "br", "bc", "cost"]].itertuples(index=False):
        onward.setdefault((ar, ac), []).append((br, bc, x))
    best: dict[tuple, int] = {}
    for r, c, x in offers[["r", "c", "cost"]].itertuples(index=False):
        best[r, c] = min(x, best.get((r, c), x))
    queue = [(x, *k) for k, x in best.items()]
    heapq.heapify(queue)
    while queue:
        x, r, c = heapq.heappop(queue)
        if x > best[r, c]:
            continue
        for br, bc, way in onward.get((r, c), ()):
            if x + way < best.get((br, bc), _FAR):
                best[br, bc] = x + way
                heapq.heappush(queue, (x + way, br, bc))
    return pd.DataFrame([(offers["id"].iloc[0], r, c, x) for (r, c), x in best.items()], columns=["id", "r", "c", "cost"])


def portal_costs(cells: DataFrame, ways: DataFrame, requests: DataFrame, tile: int = 32) -> DataFrame:
    """``id``, ``cost`` of the cheapest way of each of ``requests`` (``id``, ``r0``, ``c0``, ``r1``, ``c1``), eight steps to choose from.

    The same costs as a search over all cells. Of these only the rims and the tiles of both ends are used; between them
    costs go from rim to rim over ``ways`` (see ``portal_ways``, of the same tile size), one tile further a round, and
    only as far as they are below the cost already found. All requests share the rounds. Ids must differ. A request
    without a way, with an end that is no cell or with a null has no row.
    """
    asked = written(requests.select("id", *(F.col(x).cast("long").alias(x) for x in ("r0", "c0", "r1", "c1"))).dropna(), "requests")
    priced = cells.select(F.col("r").cast("long"), F.col("c").cast("long"), F.col("w").cast("long"), _tile("r", tile).alias("tr"), _tile("c", tile).alias("tc"))
    one = lambda goal, a, b: asked.select("id", F.lit(goal).alias("goal"), *(F.col(f"{x}{i}").alias(y + x) for i, y in ((a, "e"), (b, "o")) for x in "rc"))
    both = one(False, 0, 1).union(one(True, 1, 0))
    both = both.join(priced.select(F.col("r").alias("er"), F.col("c").alias("ec")), ["er", "ec"], "left_semi")
    both = both.withColumns({"tr": _tile("er", tile), "tc": _tile("ec", tile)})
    kind = asked.schema["id"].dataType.simpleString()
    ends = both.join(priced, ["tr", "tc"]).groupBy("id", "goal", "tr", "tc").applyInPandas(_ends(tile), f"id {kind}, goal boolean, rim boolean, r long, c long, cost long")
    ends = written(ends, "ends")
    left = ends.where("goal").select("id", "r", "c", F.col("cost").alias("left"))
    best = written(ends.where("not goal and not rim").select("id", "cost"), "best")
    fresh = written(ends.where("not goal and rim").select("id", "r", "c", "cost"), "fresh")
    known = fresh
    rim = F.pmod("r", F.lit(tile)).isin(0, tile - 1) | F.pmod("c", F.lit(tile)).isin(0, tile - 1)
    rims = written(priced.where(rim).select("r", "c", "w"), "rims")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND))).alias("s")
    while True:
        arrived = fresh.join(left, ["id", "r", "c"]).select("id", (F.col("cost") + F.col("left")).alias("cost"))
        best = written(best.union(arrived).groupBy("id").agg(F.min("cost").alias("cost")), "best")
        bound = best.withColumnRenamed("cost", "bound")
        steps = fresh.select("id", "cost", _tile("r", tile).alias("fr"), _tile("c", tile).alias("fc"), (F.col("r")).alias("r"), F.col("c"), around)
        steps = steps.select("id", "cost", "fr", "fc", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
        over = steps.where((_tile("r", tile) != F.col("fr")) | (_tile("c", tile) != F.col("fc"))).groupBy("id", "r", "c").agg(F.min("cost").alias("cost"))
        offers = over.join(rims, ["r", "c"]).select("id", "r", "c", (F.col("cost") + F.col("w")).alias("cost"))
        offers = _better(offers, known, bound).withColumns({"tr": _tile("r", tile), "tc": _tile("c", tile)})
        offers = written(offers, "offers")
        box = offers.agg(*(f(x).alias(n + x) for x in ("tr", "tc") for n, f in (("a", F.min), ("b", F.max)))).first()
        if box["atr"] is None:
            return best
        some = ways.where(F.col("tr").between(box["atr"], box["btr"]) & F.col("tc").between(box["atc"], box["btc"]))
        some = some.join(offers.select("id", "tr", "tc").distinct(), ["tr", "tc"])
        some = some.select(F.col("id").alias("of"), F.col("tr").alias("or"), F.col("tc").alias("oc"), "ar", "ac", "br", "bc", "cost")
        reached = offers.groupBy("id", "tr", "tc").cogroup(some.groupBy("of", "or", "oc")).applyInPandas(lambda o, w: _closed(w, o), f"id {kind}, r long, c long, cost long")
        fresh = written(_better(reached, known, bound), "fresh")
        known = written(known.union(fresh).groupBy("id", "r", "c").agg(F.min("cost").alias("cost")), "known")


def _better(offers: DataFrame, known: DataFrame, bound: DataFrame) -> DataFrame:
    """``offers`` (``id``, ``r``, ``c``, ``cost``) below what is known of their cell and below what their request has found."""
    before = known.withColumnRenamed("cost", "before")
    out = offers.join(before, ["id", "r", "c"], "left").join(bound, "id", "left")
    return out.where("(before is null or cost < before) and (bound is null or cost < bound)").select("id", "r", "c", "cost")
