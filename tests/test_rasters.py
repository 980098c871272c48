import heapq
import math
import random

import pytest

from pelagos.operators import raster
from pelagos.operators.graph import grid_costs
from pelagos.plans import rasters


def sees(a, b, walls):
    steps = max(1, abs(b[0] - a[0]), abs(b[1] - a[1]))
    return not any((math.floor(a[0] + (b[0] - a[0]) * (s / steps) + 0.5), math.floor(a[1] + (b[1] - a[1]) * (s / steps) + 0.5)) in walls for s in range(steps + 1))


def pulled(path, walls):
    kept, i = [0], 0
    while i < len(path) - 1:
        j = i + 1
        while j + 1 < len(path) and sees(path[i], path[j + 1], walls):
            j += 1
        kept.append(j)
        i = j
    return kept


def test_string_pull(spark):
    rng = random.Random(1)
    walls = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}
    routes, rows = {}, []
    for route in range(12):
        at, path = [rng.randrange(40), rng.randrange(40)], []
        for _ in range(rng.choice([1, 2, 3, 17, 60])):
            path.append(tuple(at))
            at = [min(39, max(0, x + rng.choice([-1, 0, 1, 1]))) for x in at]
        routes[route] = path
        rows += [(route, i, *p) for i, p in enumerate(path)]
    got = raster.string_pull(spark.createDataFrame(rows, "route long, seq long, r long, c long"), spark.createDataFrame([*walls], "r long, c long"))
    want = sorted((k, i) for k, p in routes.items() for i in pulled(p, walls))
    assert sorted(map(tuple, got.collect())) == want


def edges_of(rings):
    return [(k, *a, *b) for k, ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def test_fill(spark):
    """Random stars, a ring with a hole, a bow tie: the cells whose centre has an odd number of crossings to its left."""
    rng = random.Random(2)
    rings = [(k, [(5 + math.cos(t) * (d := rng.uniform(0.5, 4)), 5 + math.sin(t) * d) for t in (i * math.tau / 9 for i in range(9))]) for k in range(8)]
    rings += [(20, [(0, 0), (8, 0), (8, 8), (0, 8)]), (20, [(2, 2), (2, 5), (6, 5), (6, 2)]), (21, [(0, 0), (6, 6), (6, 0), (0, 6)])]
    edges = [(k, *map(float, e)) for k, *e in edges_of(rings)]
    size, want = 0.25, []
    for k in {k for k, _ in rings}:
        for r in range(-10, 60):
            for c in range(-10, 60):
                x, y = (c + 0.5) * size, (r + 0.5) * size
                crossed = sum(min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x for i, x1, y1, x2, y2 in edges if i == k)
                want += [(k, r, c)] * (crossed % 2)
    df = spark.createDataFrame(edges, "id long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, raster.fill(df, size).collect())) == sorted(want)
    assert sum(k == 20 for k, _, _ in want) == (64 - 12) * 16


def test_near_lines(spark):
    rng = random.Random(3)
    lines = [(k, *(rng.uniform(0, 6) for _ in range(4))) for k in range(30)] + [(40, 1.0, 1.0, 1.0, 1.0), (41, 0.0, 2.0, 5.0, 2.0), (42, 3.0, 0.0, 3.0, 5.0)]

    def away(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = 0 if dx == dy == 0 else max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - x1 - t * dx, y - y1 - t * dy)

    want = [(k, r, c) for k, *e in lines for r in range(-8, 40) for c in range(-8, 40) if away((c + 0.5) * 0.2, (r + 0.5) * 0.2, *e) <= 0.71]
    df = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, raster.near_lines(df, 0.71, 0.2).collect())) == sorted(want)


def test_mask(spark):
    """Stars, some of them twice or with a side in common, and a ring with a hole: cells within any of them and not near any outline."""
    rng = random.Random(4)
    rings = [(k, [(5 + math.cos(t) * (d := rng.uniform(2, 5)), 5 + math.sin(t) * d) for t in (i * math.tau / 9 for i in range(9))]) for k in range(3)]
    rings += [(k + 10, ring) for k, ring in rings[:2]] + [(20, [(10, 0), (18, 0), (18, 8), (10, 8)]), (20, [(12, 2), (12, 5), (16, 5), (16, 2)]), (21, [(18, 0), (23, 0), (18, 8)])]
    edges = spark.createDataFrame([(k, *map(float, e)) for k, *e in edges_of(rings)], "id long, x1 double, y1 double, x2 double, y2 double")
    held, band = raster.fill(edges, 0.25), raster.near_lines(edges, 0.6, 0.25)
    want = {(r["r"], r["c"]) for r in held.collect()} - {(r["r"], r["c"]) for r in band.collect()}
    got = [*map(tuple, raster.mask(edges, 0.6, 0.25).collect())]
    assert sorted(got) == sorted(want) and len(want) > 100
    assert raster.mask(edges.limit(0), 0.6, 0.25).collect() == []


def test_mask_is_not_sent_through_the_driver(spark, capsys):
    """Cells of a small file are many: with a join, Spark would go by the file's size."""
    rasters.raster_mask(spark, "/root/testdata/sf0.001").explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_border_of_rectangles(spark):
    """Two rectangles apart by 0.4 and one that laps over by 0.2: gap and overlap along ten units of border."""
    rings = [(1, [(0, 0), (4, 0), (4, 10), (0, 10)]), (2, [(4.4, 0), (8, 0), (8, 10), (4.4, 10)]), (3, [(7.8, 0), (12, 0), (12, 10), (7.8, 10)])]
    df = spark.createDataFrame([(k, *map(float, e)) for k, *e in edges_of(rings)], "id long, x1 double, y1 double, x2 double, y2 double")
    side = df.where("(id = 1 and x1 = 4 and x2 = 4) or (id = 3 and x1 = 7.8 and x2 = 7.8)")
    held = raster.fill(df, 0.1).distinct().groupBy("r", "c").count()
    band = raster.near_lines(side, 0.4, 0.1).where("r between 0 and 99").join(held, ["r", "c"], "left").fillna(0, ["count"])
    got = {(r["id"], r["count"]): r["n"] * 0.01 for r in band.groupBy("id", "count").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got[1, 0] == pytest.approx(0.4 * 10, abs=0.5) and got[3, 2] == pytest.approx(0.2 * 10, abs=0.5)
    whole = {r["id"]: r for r in raster.border_cells(df, 0.3, 0.1).collect()}
    assert set(whole) == {1, 2, 3} and whole[1]["overlap"] == 0 < whole[1]["gap"] and whole[2]["overlap"] == whole[3]["overlap"] > 0


def cheapest(cells, start, goal):
    best, queue = {start: 0}, [(0, start)]
    while queue:
        x, (r, c) = heapq.heappop(queue)
        if x > best[r, c]:
            continue
        for k in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if k in cells and x + cells[k] < best.get(k, 1 << 60):
                best[k] = x + cells[k]
                heapq.heappush(queue, (best[k], k))
    return best.get(goal)


@pytest.mark.parametrize("walls", [0, 250])
def test_corridor(spark, walls):
    rng = random.Random(walls)
    cells = {(r, c): rng.randrange(1, 30) for r in range(32) for c in range(32)}
    for k in rng.sample(sorted(cells), walls):
        if k not in ((1, 1), (30, 28)):
            del cells[k]
    df = spark.createDataFrame([(*k, w) for k, w in cells.items()], "r long, c long, w long")
    start, goal = (spark.createDataFrame([x], "r long, c long") for x in ((1, 1), (30, 28)))
    free = cheapest(cells, (1, 1), (30, 28))
    row = raster.corridor_cost(df, start, goal, 4, 1, 16).first()
    inside = {(r["r"], r["c"]): r["w"] for r in raster.corridor(df, start, goal, 4, 1, 16).collect()}
    assert row["via"] == "corridor" and row["opened"] == len(inside) < len(cells)
    assert row["cost"] == cheapest(inside, (1, 1), (30, 28)) >= free
    whole = raster.corridor_cost(df, start, goal, 4, 8, 16).first()
    assert whole["cost"] == free


def test_corridor_without_a_way(spark):
    """The corridor of coarse blocks runs into a wall of fine cells: the free search takes the way around; a full wall has none."""
    cells = {(r, c): 1 for r in range(16) for c in range(16) if c != 7 or r == 15}
    start, goal = (spark.createDataFrame([x], "r long, c long") for x in ((0, 0), (0, 15)))
    df = lambda x: spark.createDataFrame([(*k, w) for k, w in x.items()], "r long, c long, w long")
    row = raster.corridor_cost(df(cells), start, goal, 4, 0, 8).first()
    assert (row["via"], row["cost"], row["opened"]) == ("free", cheapest(cells, (0, 0), (0, 15)), len(cells))
    shut = df({k: w for k, w in cells.items() if k[1] != 7})
    assert raster.corridor_cost(shut, start, goal, 4, 1, 8).first()["via"] is None
    assert grid_costs(shut, start, 8).count() == 7 * 16
