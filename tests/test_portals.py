import heapq
import random

import pytest

from pelagos.operators.portals import portal_costs, portal_ways


def least(price, start, goal):
    if start not in price or goal not in price:
        return None
    best, queue = {start: 0}, [(0, start)]
    while queue:
        x, (r, c) = heapq.heappop(queue)
        if (r, c) == goal:
            return x
        if x > best[r, c]:
            continue
        for k in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if k in price and x + price[k] < best.get(k, 1 << 60):
                best[k] = x + price[k]
                heapq.heappush(queue, (best[k], k))
    return None


@pytest.mark.parametrize(("seed", "held", "most", "tile"), [(1, 0.7, 9, 4), (2, 0.55, 0, 5), (3, 1.0, 1, 8), (4, 0.8, 500, 32)])
def test_costs_are_those_of_all_cells(spark, seed, held, most, tile):
    """Walls, prices of zero, prices all equal, negative places, ends in one tile, ends that are no cells."""
    rng = random.Random(seed)
    price = {(r, c): rng.randint(min(1, most) * (seed == 3), most) for r in range(-9, 14) for c in range(-7, 18) if rng.random() < held}
    some = [(rng.randrange(-9, 14), rng.randrange(-7, 18)) for _ in range(24)]
    asked = [(i, *a, *b) for i, (a, b) in enumerate(zip(some, some[1:], strict=False))]
    asked += [(50, 0, 0, 0, 0), (51, 0, 0, 1, 1), (52, 99, 99, 0, 0), (53, 0, 0, 99, 99)]
    cells = spark.createDataFrame([(*k, w) for k, w in price.items()], "r long, c long, w long")
    requests = spark.createDataFrame([*asked, (54, None, 0, 1, 1)], "id long, r0 long, c0 long, r1 long, c1 long")
    got = {r["id"]: r["cost"] for r in portal_costs(cells, portal_ways(cells, tile), requests, tile).collect()}
    want = {i: x for i, a, b, c, d in asked if (x := least(price, (a, b), (c, d))) is not None}
    assert got == want


def test_no_cells_no_requests(spark):
    none = spark.createDataFrame([], "r long, c long, w long")
    asked = spark.createDataFrame([(1, 0, 0, 1, 1)], "id long, r0 long, c0 long, r1 long, c1 long")
    assert portal_costs(none, portal_ways(none), asked).collect() == []
    one = spark.createDataFrame([(0, 0, 1)], "r long, c long, w long")
    assert portal_costs(one, portal_ways(one), asked.where("id = 2")).collect() == []


def test_ways_are_few(spark):
    """On equal prices a rim's cells need not be paired with all others."""
    cells = spark.createDataFrame([(r, c, 1) for r in range(16) for c in range(16)], "r long, c long, w long")
    assert portal_ways(cells, 16).count() < 60 * 59 / 2
