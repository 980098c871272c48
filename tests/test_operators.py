"""Operators against brute force, and at their edges."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from pelagos.functions import num, scope, text, tide
from pelagos.operators import graph, ranking, sequential, spatial
from pelagos.sources import readers
from pelagos.streaming import counts


def haversine(a, b, r=6371.0):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * r * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("km,low,high", [(40.0, -60, -15), (300.0, -80, 80), (5.0, -1, 1)])
def test_radius_join(spark, km, low, high):
    rng = random.Random(int(km))
    a = [(i, rng.uniform(low, high), rng.uniform(-80, -60)) for i in range(150)]
    b = [(i, rng.uniform(low, high), rng.uniform(-80, -60)) for i in range(150)] + [(999, a[0][1], a[0][2])]
    schema = "id long, lat double, lng double"
    got = {(r["id"], r["other"]) for r in spatial.radius_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), km).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if haversine(x[1:], y[1:]) <= km}


def test_nearest_two(spark, monkeypatch):
    """Crowded and lonely places, several at one point, ids at several points, places without a point: few of the pairs within the distance are formed."""
    rng = random.Random(5)
    crowd = lambda n, lat, wide: [(lat + rng.uniform(0, wide), -70 + rng.uniform(0, wide)) for _ in range(n)]
    b = list(enumerate([*crowd(500, -30, 0.5), *crowd(200, -30.2, 0.01), *crowd(20, -31, 9), (-45.0, -70.0), (-50.0, -70.0), (-50.0, -70.0)]))
    b += [(k + 1000, at) for k, at in b[100:150]] + [(5000, (None, None)), (5001, (None, -70.0))]
    a = list(enumerate([*crowd(300, -30, 0.5), *crowd(50, -30.2, 0.01), *crowd(30, -31, 9), (-45.0, -70.0), (-45.3, -70.0), (-50.4, -70.0), (-60.0, -70.0), b[120][1], (None, -70.0)]))
    a += [(k, at) for k, at in a[:20]] + [(k + 400, at) for k, at in a[20:40]] + [(1, (-50.4, -70.0)), (2, (-45.0, -70.0))]
    want = {}
    for i, p in a:
        want.setdefault(i, []).extend((km, o) for o, q in b if p[0] and q[0] and (km := haversine(p, q)) <= 200)
    want = {i: (*sorted(near)[:2], None)[:2] for i, near in want.items() if near}
    formed, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *x: formed.append((df := join(*x)).count()) or df)
    left, right = (spark.createDataFrame([(k, *at) for k, at in x], "id long, lat double, lng double") for x in (a, b))
    got = {r["id"]: r for r in spatial.nearest_two(left, right, 200.0).collect()}
    assert got.keys() == want.keys() and {i: r["other"] for i, r in got.items()} == {i: x[0][1] for i, x in want.items()}
    for i, (first, second) in want.items():
        assert got[i]["km"] == pytest.approx(first[0]) and (got[i]["second"] == pytest.approx(second[0]) if second else got[i]["second"] is None)
    assert {len(x) - x.count(None) for x in want.values()} == {1, 2} and sum(formed) < 60 * len(a)
    assert spatial.nearest_two(left, right.limit(0), 200.0).collect() == [] and spatial.nearest_two(left.limit(0), right, 200.0).collect() == []


def test_overlaps_and_unions(spark):
    rng = random.Random(3)
    rows = [(g, i, float(a), float(a + rng.randint(0, 12))) for g in range(4) for i, a in enumerate(rng.choices(range(60), k=25))]
    df = spark.createDataFrame(rows, "g long, id long, lo double, hi double")
    pairs = {(r["g"], r["a"], r["b"]) for r in spatial.overlapping(df, "g").collect()}
    assert pairs == {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]}
    assert spatial.overlapping(df, "g").count() == len(pairs)
    merged = spatial.union_of_intervals(df, "g").collect()
    for g in range(4):
        cover = {t for r in merged if r["g"] == g for t in range(int(r["lo"]), int(r["hi"]))}
        assert cover == {t for x in rows if x[0] == g for t in range(int(x[2]), int(x[3]))}
    assert spatial.overlapping(df.limit(0), "g").collect() == [] and spatial.union_of_intervals(df.limit(0), "g").collect() == []


def limits(times, limit, seconds):
    opened, n, out = None, 0, []
    for t in times:
        if opened is None or (t - opened).total_seconds() >= seconds:
            opened, n = t, 0
        out.append(n < limit)
        n += 1
    return out


def test_rate_limits_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.randint(0, 3), start + datetime.timedelta(seconds=i * 40 + rng.randint(0, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    want = {}
    for u in range(4):
        mine = [r for r in rows if r[1] == u]
        want |= dict(zip((r[0] for r in mine), limits([r[2] for r in mine], 2, 600)))
    assert {r["event_id"]: r["allowed"] for r in sequential.allowed(df, "user_id", "ts", ["ts", "event_id"], 2, 600).collect()} == want
    for k in range(3):
        df.where((F.col("event_id") >= k * 100) & (F.col("event_id") < k * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = counts.event_stream(spark, str(tmp_path / "in"), df.schema)
    got = {r["event_id"]: r["allowed"] for r in counts.drained(counts.limited(stream, 2, 600), "limited").collect()}
    assert got == want


def test_breaker(spark):
    start = datetime.datetime(2024, 1, 1)
    fails = [1, 1, 0, 1, 1, 1, 0, 0, 1, 0]
    at = [0, 1, 2, 3, 4, 5, 6, 70, 71, 72]
    df = spark.createDataFrame([(i, "s", start + datetime.timedelta(seconds=t), bool(f)) for i, (t, f) in enumerate(zip(at, fails))], "id long, k string, ts timestamp, failed boolean")
    got = [r["state"] for r in sequential.breaker(df, "k", "ts", "failed", ["ts"], 3, 60).orderBy("id").collect()]
    assert got == ["CLOSED"] * 6 + ["OPEN", "HALF_OPEN", "CLOSED", "CLOSED"]


def test_graphs(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(df).collect()} == {x: root(x) for x in top}
    assert graph.components(df.limit(0)).collect() == []
    edges = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)], "a long, b long, w double")
    costs = graph.least_costs(edges, spark.createDataFrame([(0,)], "node long"), 9)
    assert {r["node"]: r["cost"] for r in costs.collect()} == {0: 0.0, 2: 1.0, 1: 2.0, 3: 3.0}


# Texts and what must be read from them.
@pytest.mark.parametrize("said,threshold", [
    ("EEMM-50AB", 50), ("EEMM <25 AB", 25), ("EE.MM. A 25 A.B.", 25), ("30 TRG", 30), ("embarcaciones menores de 12 A/B", 12), ("TODO TIPO DE NAVES", None), ("", None), (None, None),
])
def test_thresholds(spark, said, threshold):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(text.first_number(text.normalize(F.col("t")), text.THRESHOLDS)).first()[0] == threshold


def test_numbers(spark):
    df = spark.createDataFrame([(" 7 ",), ("",), (None,), ("x",), ("1.5",)], "t string")
    assert [r[0] for r in df.select(num.tolerant_number(F.col("t"))).collect()] == [7.0, None, None, None, 1.5]
    assert [r[0] for r in spark.createDataFrame([(-0.5,), (0.5,), (2.45,)], "x double").select(num.half_up(F.col("x"))).collect()] == [0.0, 1.0, 2.0]


# Texts of closures and whom they reach.
@pytest.mark.parametrize("said,want", [
    ("Puerto cerrado para EE.MM. de 25 AB dentro", ("limit", 25, "AB")), ("CERRADO PARA 50 AB", ("limit", 50, "AB")), ("Para naves menores, cerrado", (None, None, None)),
    ("Cerrado para todo tipo de embarcaciones menores", ("minors", None, None)), ("Cerrado para naves mayores y menores de 12 TRG", ("unsummed", None, None)),
    ("Puerto cerrado para EE MM menores de 25 AB; y para menores de 30 A.B.", ("limit", 30, "AB")), ("CIERRE PARA 12 TRG Y PARA 12 AB", ("unsummed", None, None)),
    ("CERRAZON DE NIEBLA PARA NAVES MENORES", (None, None, None)), ("Cerrado para naves y embarcaciones", ("total", None, None)), ("cerrado por viento con naves superiores a 25 AB", (None, None, None)),
    ("", (None, None, None)), (None, (None, None, None)), ("Cerrado para menores y para menores de 10 AB", ("minors", None, None)),
    ("Cerrado para 25 AB; cierre para 12 TRG; cierre para todo tipo de naves", ("unsummed", None, None)),
    ("Cerrado para naves mayores", ("unsummed", None, None)), ("Cerrado para naves mayores; cierre para menores; cierre para 25 AB", ("total", None, None)),
])
def test_closure_scopes(spark, said, want):
    df = spark.createDataFrame([(said,)], "t string").select(scope.parts(F.col("t")).alias("p"))
    assert tuple(df.select(scope.union(F.col("p")).alias("s")).select("s.*").first()) == want


@pytest.mark.parametrize("tile", [3, 8, 100])
def test_grid_costs(spark, tile):
    import heapq

    rng = random.Random(tile)
    cells = {(r, c): rng.randint(0, 9) for r in range(-5, 20) for c in range(20) if rng.random() < 0.8} | {(2, 2): 1, (50, 50): 1}
    best, queue = {(2, 2): 0}, [(0, 2, 2)]
    while queue:
        x, r, c = heapq.heappop(queue)
        for k in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if k in cells and x + cells[k] < best.get(k, 1 << 30):
                best[k] = x + cells[k]
                heapq.heappush(queue, (best[k], *k))
    df = spark.createDataFrame([(*k, w) for k, w in cells.items()], "r long, c long, w long").repartition(3)
    got = graph.grid_costs(df, spark.createDataFrame([(2, 2)], "r long, c long"), tile).collect()
    assert {(r["r"], r["c"]): r["cost"] for r in got} == best and (50, 50) not in best


def test_places_in_an_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x long").repartition(5)
    got = {r["id"]: r["place"] for r in ranking.ranked(df, [F.desc_nulls_last("x"), F.asc("id")], "place").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    assert ranking.ranked(df.limit(0), [F.asc("id")], "place").collect() == []


def test_distances_across_the_date_line(spark):
    a = spark.createDataFrame([(1, -20.0, 179.9), (2, -20.0, -179.95)], "id long, lat double, lng double")
    b = spark.createDataFrame([(7, -20.0, -179.9), (8, -20.0, 179.8), (9, -20.0, 0.0)], "id long, lat double, lng double")
    got = {(r["id"], r["other"]) for r in spatial.radius_join(a, b, 40.0).collect()}
    assert got == {(x, y) for x, p in ((1, (-20.0, 179.9)), (2, (-20.0, -179.95))) for y, q in ((7, (-20.0, -179.9)), (8, (-20.0, 179.8)), (9, (-20.0, 0.0))) if haversine(p, q) <= 40}
    assert (1, 7) in got and (2, 8) in got


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lon\ncount,degrees\n1,200.5\n2,-70\n3,\n,100\nx9,30\n", encoding="utf-8")
    got = readers.csv_with_units(spark, str(tmp_path / "a.csv"), "id long, lon double", "count,degrees").select("id", readers.west(F.col("lon"))).collect()
    assert [tuple(r) for r in got] == [(1, -159.5), (2, -70.0), (3, None), (None, 100.0), (None, 30.0)]
    (tmp_path / "b.csv").write_text('﻿name,note\n"a ""b"", c","two\nlines"\nx,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.quoted_csv(spark, str(tmp_path / "b.csv"), "name string, note string").collect()] == [('a "b", c', "two\nlines"), ("x", None)]
    (tmp_path / "c.json").write_text('{"recordsets": [[{"id": 1}, {"id": 2}], []]}\n{"recordsets": []}\nbroken\n', encoding="utf-8")
    assert [r["id"] for r in readers.json_records(spark, str(tmp_path / "c.json"), "struct<id:long>").collect()] == [1, 2]
    kept = readers.json_records(spark, str(tmp_path / "c.json"), "struct<id:long>", "broken").collect()
    assert [(r["id"], r["broken"]) for r in kept] == [(1, None), (2, None), (None, "broken")]
    (tmp_path / "d.csv").write_text("a,b\na,x\nu,v\n", encoding="utf-8")
    assert [tuple(r) for r in readers.csv_with_units(spark, str(tmp_path / "d.csv"), "a string, b string", "u,v").collect()] == [("a", "x")]
    assert [tuple(r) for r in readers.quoted_csv(spark, str(tmp_path / "d.csv"), "a string, b string").collect()] == [("a", "x"), ("u", "v")]
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],)], "x array<double>").select(readers.points_of(F.col("x")).alias("p")).collect()
    assert [[tuple(p) for p in r["p"] or []] for r in flat] == [[(1.0, 2.0), (3.0, 4.0)], []]


@pytest.mark.parametrize("kinds,want", [
    (["majors", "AB25", "minors"], ("unsummed", None, None)), (["AB25", "TRG12", "total"], ("unsummed", None, None)), (["AB25", "AB30", "minors"], ("minors", None, None)),
    (["majors", "minors", "AB25"], ("total", None, None)), (["AB25", "minors", "majors"], ("total", None, None)), (["AB30", "AB25"], ("limit", 30, "AB")), (["majors"], ("unsummed", None, None)), ([], (None, None, None)),
])
def test_parts_fold_in_order(spark, kinds, want):
    parts = [("limit", int(k.strip("ABTRG")), k.strip("0123456789")) if k[-1].isdigit() else (k, None, None) for k in kinds]
    df = spark.createDataFrame([(parts,)], "p array<struct<kind:string,limit:bigint,unit:string>>")
    assert tuple(df.select(scope.union(F.col("p")).alias("s")).select("s.*").first()) == want


def test_sources_in_turn(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet", encoding="utf-8")
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "good.parquet"))
    read = lambda name: (name, lambda: spark.read.parquet(str(tmp_path / f"{name}.parquet")))
    name, rows, failed = readers.first_readable([read("missing"), read("bad"), read("none"), read("good"), read("missing")])
    assert name == "good" and rows.count() == 3 and list(failed) == ["missing", "bad", "none"] and failed["none"] == "empty"
    assert readers.first_readable([read("missing")])[:2] == (None, None)


def test_tide(spark):
    """Arguments turn at the published speeds in degrees an hour; node factors stay in their published ranges and are 1 in the mean of a node's turn."""
    # Speeds of the constituents.
    speeds = {"M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K2": 30.0821373, "K1": 15.0410686, "O1": 13.9430356, "P1": 14.9589314, "Q1": 13.3986609, "M4": 57.9682084, "MS4": 58.9841042, "MN4": 57.4238337, "SA": 0.0410667, "SSA": 0.0821373}
    start, step = 946_728_000, 3_600_000
    rows = tide.arguments(spark.createDataFrame([(start + i * step,) for i in range(164)], "at long"), "at").orderBy("at").collect()
    for name, speed in speeds.items():
        for a, b in zip(rows[::40], rows[1::40], strict=False):
            turned = (b[f"v_{name}"] - a[f"v_{name}"] - speed * 1000 + 180) % 360 - 180
            assert abs(turned) < 0.02, name
    low_high = {"M2": (0.963, 1.038), "O1": (0.805, 1.184), "K1": (0.881, 1.114), "K2": (0.746, 1.318)}
    for name, (low, high) in low_high.items():
        f = [r[f"fa_{name}"] for r in rows]
        assert low - 0.01 < min(f) < low + 0.03 and high - 0.03 < max(f) < high + 0.01, name
        assert abs(sum(f) / len(f) - 1) < 0.03
    # Mean longitudes of moon and sun at noon of 1 January 2000.
    assert abs(rows[0]["s"] - 218.316) < 0.01 or abs(rows[0]["h"] - 280.466) < 0.01
    h = tide.heights(spark.createDataFrame([(start,)], "t long"), "t", 900.0, [("M2", 100.0, 30.0), ("S2", 50.0, 0.0)]).first()["height"]
    r = rows[0]
    assert abs(h - (900 + 100 * r["fa_M2"] * math.cos(math.radians(r["v_M2"] + r["ua_M2"] - 30)) + 50 * math.cos(math.radians(r["v_S2"])))) < 1e-6
    # at noon of the meridian the hour angle of the sun is zero: S2 stands at 0 or 180 degrees
    assert min(r["v_S2"] % 180, 180 - r["v_S2"] % 180) < 1e-6
