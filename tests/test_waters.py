"""Bounded floods, seeds, zones that reach a place: against plain searches."""

import math
import random

import pytest

from pelagos.operators import waters


def flood(water, seed, centre, margin, bound, out):
    ok = lambda k: k in water and k not in out and max(abs(k[0] - centre[0]), abs(k[1] - centre[1])) <= margin
    seen, queue = {seed} if ok(seed) else set(), [seed] if ok(seed) else []
    while queue:
        r, c = queue.pop()
        for k in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if k not in seen and ok(k):
                seen.add(k)
                queue.append(k)
    return min(len(seen), bound), len(seen) >= bound


@pytest.mark.parametrize("bound", [1, 12, 10_000])
def test_bounded_waters(spark, bound):
    """Random waters, also left of and below zero; seeds on land, outside their window, alone, without any water near."""
    rng = random.Random(bound)
    water = {(r, c) for r in range(-20, 40) for c in range(-20, 40) if rng.random() < 0.42}
    seeds = {k: ((r := rng.randrange(-22, 42)), (c := rng.randrange(-22, 42)), r + rng.randrange(-3, 4), c + rng.randrange(-3, 4)) for k in range(60)}
    seeds |= {100: (900, 900, 900, 900), 101: (0, 0, 30, 30)}
    out = {(k, r + i, c + j) for k, (r, c, *_) in seeds.items() if k % 3 == 0 for i in (-1, 0) for j in (2, 3)}
    got = waters.bounded_waters(
        spark.createDataFrame([*water, (0, 0), (0, 0)], "r long, c long"), spark.createDataFrame([(k, *x) for k, x in seeds.items()], "id long, r long, c long, r0 long, c0 long"),
        7, bound, spark.createDataFrame([*out], "id long, r long, c long"),
    )
    water |= {(0, 0)}
    want = {k: flood(water, (r, c), (r0, c0), 7, bound, {(a, b) for i, a, b in out if i == k}) for k, (r, c, r0, c0) in seeds.items()}
    assert {r["id"]: (r["size"], r["bounded"]) for r in got.collect()} == want


def test_seeds_near(spark):
    rng = random.Random(4)
    water = {(r, c) for r in range(20) for c in range(20) if rng.random() < 0.08}
    anchors = {k: (rng.randrange(20), rng.randrange(20)) for k in range(40)}
    out = {(k, *p) for k in anchors for p in water if (k + p[0]) % 4 == 0}
    want = {}
    for k, (r, c) in anchors.items():
        rings = sorted((max(abs(i), abs(j)), i, j) for i in range(-3, 4) for j in range(-3, 4) if i or j)
        hit = [(r + i, c + j) for _, i, j in rings if (r + i, c + j) in water and (k, r + i, c + j) not in out]
        if hit:
            want[k] = hit[0]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = waters.seeds_near(frame([(k, *p) for k, p in anchors.items()], "id long, r long, c long"), frame([*water], "r long, c long"), 3, frame([*out], "id long, r long, c long"))
    assert {r["id"]: (r["r"], r["c"]) for r in got.collect()} == want and len(want) < len(anchors)


def test_zones_reaching(spark):
    rng = random.Random(5)
    points = [(k, rng.uniform(-3, 9), rng.uniform(-3, 9)) for k in range(300)] + [(900, 2.0, 2.0), (901, None, 1.0)]
    zones = [(k, *(rng.uniform(0, 6) for _ in range(4)), rng.uniform(0, 1.5)) for k in range(12)]
    zones += [(k, x, y, x + 1, y, 0.4) for k in range(6) for x, y in [(rng.uniform(0, 6), rng.uniform(0, 6))]] + [(50, 2.0, 2.0, 2.0, 2.0, 0.0), (51, 5.0, 2.0, 5.0, 2.0, 3.0), (52, 2.0, 2.0, 2.0, 2.0, None)]

    def away(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = 0 if dx == dy == 0 else max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - x1 - t * dx, y - y1 - t * dy)

    want = []
    for k, x, y in points:
        near = {}
        for zone, *e, buffer in zones:
            if x is not None and buffer is not None and (d := away(x, y, *e)) <= buffer:
                near[zone] = min(d, near.get(zone, d))
        want += [(k, zone, i + 1) for i, (_, zone) in enumerate(sorted((d, z) for z, d in near.items()))]
    got = waters.zones_reaching(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(zones, "zone long, x1 double, y1 double, x2 double, y2 double, buffer double"), 0.5)
    assert sorted((r["id"], r["zone"], r["place"]) for r in got.collect()) == sorted(want)
    assert {zone for k, zone, _ in want if k == 900} >= {50, 51} and not any(zone == 52 for _, zone, _ in want)


@pytest.mark.parametrize("share", [0.5, 0.95])
def test_least_widths(spark, share):
    rng = random.Random(share)
    water = {(r, c) for r in range(-9, 21) for c in range(-9, 21) if rng.random() < share} | {(100, 100)}

    def steps(r, c, i, j):
        return next((k for k in range(1, 8) if (r + i * k, c + j * k) not in water), 7)

    want = {(r, c): min(steps(r, c, i, j) + steps(r, c, -i, -j) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1))) for r, c in water}
    got = waters.least_widths(spark.createDataFrame([*water, (100, 100)], "r long, c long"), 7)
    assert {(r["r"], r["c"]): r["width"] for r in got.collect()} == want and want[100, 100] == 2
