"""Graphs as tables of links: components and least costs, by rounds that end when nothing changes."""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.sources.scratch import written


def _stars(batches):
    """Links of one task as links to the smallest node that they reach within the task: at most one a node."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            top.setdefault(a, a)
            top.setdefault(b, b)
            x, y = (root(n) for n in (a, b))
            top[max(x, y)] = min(x, y)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) of all nodes with a link (``a``, ``b``: whole numbers).

    First each task joins what its own links join. A round then takes the least label of the neighbours and the
    label's own label, so rounds follow the logarithm of a component's width.
    """
    near = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    stars = written(near.mapInArrow(_stars, "a long, b long"), "stars")
    both = written(stars.union(stars.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    before = None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = step.alias("x").join(step.alias("y"), F.col("x.root") == F.col("y.node")).select(F.col("x.node").alias("node"), F.least("x.root", "y.root").alias("root"))
        labels = written(jump, "labels")
        now = labels.agg(F.sum("root")).first()[0]  # labels only fall
        if now == before:
            return labels
        before = now


def least_costs(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """``node``, ``cost`` of the cheapest way from ``start`` (``node``) over ``edges`` (``a``, ``b``, ``w`` >= 0) of at most ``rounds`` steps."""
    known = written(start.select("node", F.lit(0.0).alias("cost")).distinct(), "costs")
    for _ in range(rounds):
        onward = known.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        after = written(known.union(onward).groupBy("node").agg(F.min("cost").alias("cost")), "costs")
        same = after.join(known, ["node", "cost"], "left_anti").limit(1).count() == 0
        known = after
        if same:
            break
    return known


def _spread(rows: pd.DataFrame) -> pd.DataFrame:
    """Least costs within one tile from the cells that have a cost."""
    price = dict(zip(zip(rows["r"].tolist(), rows["c"].tolist(), strict=True), rows["w"].tolist(), strict=True))
    best = {k: int(x) for k, x in zip(price, rows["cost"].tolist(), strict=True) if pd.notna(x)}
    queue = [(x, *k) for k, x in best.items()]
    heapq.heapify(queue)
    while queue:
        x, r, c = heapq.heappop(queue)
        if x > best[r, c]:
            continue
        for k in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if k in price and x + price[k] < best.get(k, 1 << 62):
                best[k] = x + price[k]
                heapq.heappush(queue, (best[k], *k))
    return rows.assign(cost=pd.array([best.get(k) for k in price], dtype="Int64"))


def grid_costs(cells: DataFrame, start: DataFrame, tile: int = 64) -> DataFrame:
    """``r``, ``c``, ``cost`` of the cheapest way from ``start`` (``r``, ``c``) over cells (``r``, ``c``, ``w`` >= 0, whole numbers), eight steps to choose from, ``w`` the price of entering.

    A task spreads costs within a tile; costs then cross to the tiles beside it, and those that are offered less
    spread again, until none is. Rounds follow the tiles along a way, not its cells. Cells out of reach have no row.
    """
    at = lambda x: F.floor(F.col(x) / tile)
    known = cells.select("r", "c", F.col("w").cast("long").alias("w"), F.lit(None).cast("long").alias("cost"), at("r").alias("tr"), at("c").alias("tc"))
    offers = start.select("r", "c", F.lit(0).cast("long").alias("offer"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))).alias("s")
    while True:
        better = F.col("offer").isNotNull() & (F.col("cost").isNull() | (F.col("offer") < F.col("cost")))
        fresh = known.join(offers, ["r", "c"], "left").withColumn("better", better)
        fresh = fresh.withColumn("cost", F.when(F.col("better"), F.col("offer")).otherwise(F.col("cost")))
        fresh = fresh.withColumn("again", F.max("better").over(W.Window.partitionBy("tr", "tc"))).drop("offer", "better")
        fresh = written(fresh, "offered")
        if fresh.where("again").isEmpty():
            return fresh.where("cost is not null").select("r", "c", "cost")
        names = ["r", "c", "w", "cost", "tr", "tc"]
        spread = fresh.where("again").select(*names).groupBy("tr", "tc").applyInPandas(_spread, known.schema)
        known = written(spread.union(fresh.where("not again").select(*names)), "costs")
        edge = known.where("cost is not null").where((F.pmod("r", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("c", F.lit(tile)).isin(0, tile - 1)))
        steps = edge.select("r", "c", "cost", "tr", "tc", around).select((F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), "cost", "tr", "tc")
        over = steps.where((at("r") != F.col("tr")) | (at("c") != F.col("tc"))).groupBy("r", "c").agg(F.min("cost").alias("x"))
        offers = over.join(cells.select("r", "c", F.col("w").cast("long").alias("w")), ["r", "c"]).select("r", "c", (F.col("x") + F.col("w")).alias("offer"))
