"""Rasters as binary files: rows of 16-bit numbers, in one file or in bands of rows, with a description beside them.

A tile in a folder is ``<tile>.meta.json`` (``rows`` and ``cols`` at least) with ``<tile>.bin``, or with bands
``<tile>.bands/<first row>.bin``. Numbers are unsigned, little-endian, row by row; 0 stands for no data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_BYTES, _TOP = 2, 65_535
SCHEMA = "tile string, r long, c long, v int, problem string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Arrow knows it (local, ``hdfs:``, ``s3:``, ``gs:``), and the path there."""
    return fs.FileSystem.from_uri(path.rstrip("/"))


def _json(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class _Rows(InputPartition):
    """Some rows of a tile within one file, or what is wrong with the tile."""

    tile: str
    file: str = ""
    skip: int = 0
    first: int = 0
    rows: int = 0
    cols: int = 0
    problem: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("rowspertask", 512))
        self.low, self.high = int(options.get("fromrow", 0)), int(options.get("torow", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        system, top = _open(self.path)
        sizes = {i.path: i.size for i in system.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file}
        out = []
        for meta in sorted(p for p in sizes if p.endswith(".meta.json")):
            tile = meta.removesuffix(".meta.json")
            name = tile.rsplit("/", 1)[-1]
            try:
                said = _json(system, meta)
                rows, cols = int(said["rows"]), int(said["cols"])
            except (ValueError, KeyError, TypeError) as e:
                out.append(_Rows(name, problem=f"no rows and cols in the description: {e!r}"))
                continue
            bands = sorted((int(p.rsplit("/", 1)[-1].removesuffix(".bin")), p) for p in sizes if p.startswith(tile + ".bands/") and p.endswith(".bin"))
            bands = bands or [(0, tile + ".bin")]
            ends = [first for first, _ in bands[1:]] + [rows]
            bad = [(p, sizes.get(p, 0), (end - first) * cols * _BYTES) for (first, p), end in zip(bands, ends, strict=True)]
            bad = [f"{p.removeprefix(top + '/')} has {a} bytes, expected are {b}" for p, a, b in bad if a != b]
            if bad or bands[0][0]:
                out.append(_Rows(name, problem="; ".join(bad) or "the first row is missing"))
                continue
            for (first, p), end in zip(bands, ends, strict=True):
                for r in range(max(first, self.low), min(end, self.high + 1), self.step):
                    n = min(self.step, end - r, self.high + 1 - r)
                    out.append(_Rows(name, p, (r - first) * cols * _BYTES, r, n, cols))
        return out or [_Rows("", problem="no tile")]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        names = ["tile", "r", "c", "v", "problem"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        if part.problem:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part.tile or None, None, None, None, part.problem), types, strict=True)], names=names)
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.file) as f:
            f.seek(part.skip)
            for r in range(part.first, part.first + part.rows):
                v = np.frombuffer(f.read(part.cols * _BYTES), "<u2").astype(np.int32)
                n = len(v)
                arrays = [pa.array([part.tile] * n), pa.array(np.full(n, r)), pa.array(np.arange(n)), pa.array(v), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    """Writes bands as they come (rows in order of tile, band); the description comes last, so that a tile without it is none."""

    def __init__(self, options: dict):
        self.path, self.band = options["path"], int(options["band"])
        self.tiles = json.loads(options["tiles"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, top = _open(self.path)
        files, now, cells = [], None, None

        def flush() -> None:
            if now is not None:
                tile, first = now
                system.create_dir(f"{top}/{tile}.bands", recursive=True)
                file = f"{top}/{tile}.bands/{first:09d}.bin"
                with system.open_output_stream(file) as f:
                    f.write(cells.astype("<u2").tobytes())
                files.append(file)

        for batch in batches:
            rows = batch.to_pandas()
            for key, part in rows.groupby(["tile", "first"], sort=False):
                if key != now:
                    flush()
                    now = key
                    said = self.tiles[key[0]]
                    cells = np.zeros((min(self.band, said["rows"] - key[1]), said["cols"]), np.int64)
                part = part[part["c"].notna()]
                cells[part["r"].astype(int) - now[1], part["c"].astype(int)] = part["v"]
        flush()
        return _Written(files)

    def commit(self, messages: list) -> None:
        system, top = _open(self.path)
        for tile, said in self.tiles.items():
            with system.open_output_stream(f"{top}/{tile}.meta.json") as f:
                f.write(json.dumps({"tile_id": tile, "dtype": "uint16", "nodata": 0, **said}).encode())

    def abort(self, messages: list) -> None:
        system, _ = _open(self.path)
        for file in (f for m in messages if m for f in m.files):
            system.delete_file(file)


class Rasters(DataSource):
    """Format ``raster``: the cells of all tiles of a folder; options ``rowsPerTask``, ``fromRow``, ``toRow``."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def read_tiles(spark: SparkSession, path: str, rows_per_task: int = 512, rows: tuple[int, int] | None = None) -> DataFrame:
    """``tile``, ``r``, ``c``, ``v``, ``problem`` of a folder's tiles; tasks read ranges of rows, ``rows`` keeps those from one to another.

    A tile whose files have not the size that its description says has one row: its name and the ``problem``.
    """
    spark.dataSource.register(Rasters)
    reader = spark.read.format("raster").option("rowsPerTask", rows_per_task)
    if rows:
        reader = reader.option("fromRow", rows[0]).option("toRow", rows[1])
    return reader.load(path)


def write_tiles(cells: DataFrame, path: str, tiles: dict[str, dict], band: int = 512) -> None:
    """Writes cells (``tile``, ``r``, ``c``, ``v`` of 0 to 65,535) as bands of ``band`` rows; ``tiles`` describes each tile (``rows``, ``cols``, any more).

    Of several values for one cell the greatest counts; a cell outside its tile or a value outside the range ends the
    job with an error. A task holds one band. A tile's description is written when all bands are.
    """
    spark = cells.sparkSession
    spark.dataSource.register(Rasters)
    said = spark.createDataFrame([(t, x["rows"], x["cols"]) for t, x in tiles.items()], "tile string, rows long, cols long")
    fits = F.col("r").between(0, F.col("rows") - 1) & F.col("c").between(0, F.col("cols") - 1) & F.col("v").between(0, _TOP)
    given = cells.select("tile", "r", "c", "v").join(said, "tile", "left")
    v = F.when(fits, F.col("v")).otherwise(F.raise_error(F.format_string("no place for cell %s, %s of tile %s", "r", "c", "tile")).cast("int"))
    best = given.withColumn("v", v).groupBy("tile", "r", "c").agg(F.max("v").alias("v"))
    bands = said.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(band).cast("long"))).alias("first"))
    full = bands.join(best.withColumn("first", (F.floor(F.col("r") / band) * band).cast("long")), ["tile", "first"], "left")
    placed = full.select("tile", "first", "r", "c", F.col("v").cast("int").alias("v")).repartition("tile", "first").sortWithinPartitions("tile", "first")
    placed.write.format("raster").mode("append").option("band", band).option("tiles", json.dumps(tiles)).save(path)
