"""Rasters as binary files: round trips, files as delivered, wrong sizes, ranges of rows."""

import json

import numpy as np
import pytest

from pelagos.sources import readers, tiles


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    grids = {"a": rng.integers(0, 65_536, (37, 19)), "b": np.zeros((5, 3), int)}
    cells = [(t, r, c, int(v)) for t, g in grids.items() for (r, c), v in np.ndenumerate(g) if v] + [("a", 0, 0, 0)]
    tiles.write_tiles(spark.createDataFrame(cells, "tile string, r long, c long, v long"), str(tmp_path), {t: {"rows": g.shape[0], "cols": g.shape[1], "unit_m": 10} for t, g in grids.items()}, 8)
    assert (tmp_path / "a.bands").is_dir() and len(list((tmp_path / "a.bands").iterdir())) == 5
    assert json.loads((tmp_path / "a.meta.json").read_text())["unit_m"] == 10
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "a.bands").iterdir())) == grids["a"].astype("<u2").tobytes()
    got = {(r["tile"], r["r"], r["c"]): r["v"] for r in tiles.read_tiles(spark, str(tmp_path), 3).collect()}
    assert got == {(t, r, c): v for t, g in grids.items() for (r, c), v in np.ndenumerate(g)}
    some = tiles.read_tiles(spark, str(tmp_path), 3, (6, 17))
    assert sorted({r["r"] for r in some.where("tile = 'a'").collect()}) == list(range(6, 18)) and some.rdd.getNumPartitions() == 5


def test_as_delivered_and_wrong_sizes(spark, tmp_path):
    g = np.arange(12).reshape(3, 4)
    for name, data, said in (("good", g.astype("<u2").tobytes(), {"rows": 3, "cols": 4}), ("short", b"xx", {"rows": 3, "cols": 4}), ("none", None, {"rows": 1, "cols": 1}), ("odd", b"", {"rows": 1})):
        (tmp_path / f"{name}.meta.json").write_text(json.dumps(said))
        if data is not None:
            (tmp_path / f"{name}.bin").write_bytes(data)
    rows = tiles.read_tiles(spark, str(tmp_path)).collect()
    assert {(r["r"], r["c"]): r["v"] for r in rows if r["tile"] == "good"} == dict(np.ndenumerate(g))
    bad = {r["tile"]: r["problem"] for r in rows if r["problem"]}
    assert bad.keys() == {"short", "none", "odd"} and bad["short"] == "short.bin has 2 bytes, expected are 24"
    assert len(rows) == 12 + 3


@pytest.mark.parametrize("row", [("a", 3, 0, 1), ("a", 0, -1, 1), ("a", 0, 0, 65_536), ("z", 0, 0, 1), ("a", 0, 0, None)])
def test_cells_without_a_place(spark, tmp_path, row):
    with pytest.raises(Exception, match="no place for cell"):
        tiles.write_tiles(spark.createDataFrame([row], "tile string, r long, c long, v long"), str(tmp_path), {"a": {"rows": 3, "cols": 2}})
    assert not list(tmp_path.glob("*.meta.json"))


def test_literal_entries(spark):
    whole = """const OTHER = { 1: { lat: 9, lng: 9, nombre: 'no' } };
const PLACES = {
  // bays
  12: { lat: -41.5, lng: -72.9, nombre: 'Bahía "Uno"', extra: 1 },
  13:
    { lat: -42, lng: 73.25, nombre: "O'Higgins" },
  14: { lat: 1.5, lng: 2, nombre: 'l\\'Ile' },
};
  15: { lat: 1, lng: 2, nombre: 'after' },
"""
    twice = "const PLACES = {\n 1: { lat: 1, lng: 2, nombre: 'a' },\n 1: { lat: 3, lng: 4, nombre: 'b' },\n 2: { lng: 2, nombre: 'a' },\n 3: { lat: 1.2.3, lng: 2, nombre: 'a' },\n};"
    files = [("whole", whole), ("twice", twice), ("none", "const PLACE = {}"), ("open", "const PLACES = {\n 1: {"), ("empty", "const PLACES = {\n};"), ("null", None)]
    rows = readers.literal_entries(spark.createDataFrame(files, "file string, text string"), "PLACES").collect()
    of = lambda f: sorted((tuple(r)[1:] for r in rows if r["file"] == f), key=repr)
    assert of("whole") == [(12, -41.5, -72.9, 'Bahía "Uno"', None), (13, -42.0, 73.25, "O'Higgins", None), (14, 1.5, 2.0, "l\\'Ile", None)]
    assert of("twice") == [(1, 1.0, 2.0, "a", "repeated key"), (1, 3.0, 4.0, "b", "repeated key"), (2, None, None, None, "unreadable"), (3, None, 2.0, "a", "unreadable")]
    assert [of(f)[0][-1] for f in ("none", "open", "empty", "null")] == ["not declared", "not closed", "no entries", "not declared"] and len(rows) == 11
