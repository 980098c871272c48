"""Whitening of vectors by a tall-skinny QR: the covariance matrix is never formed."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored, table

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Triangles merged by one task in each round of the tree.
FAN_IN = 8
#: Rows stacked under the triangle before it is formed anew.
ROWS_AT_ONCE = 4096
_LIMIT = 1 << 62


def whole(vector: Column) -> Column:
    """Entries as whole numbers. What would leave the range of a long stays at +-2**62."""
    bound = float(_LIMIT)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(bound)), F.lit(-bound))) + F.lit(OFFSET))


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries. Empty vectors are usable, but have no components."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _by_size(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows have vectors of each size, and these vectors as a matrix of 64-bit integers."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = []
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[ends[rows][:, None] + np.arange(d)]))
    return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as 64-bit integers where they hold it, else as Python's."""
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max(abs(s) for s in sums)
    if most < _LIMIT:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By vector size: how many distinct vectors, and the exact sum of each dimension."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for rows, x in _by_size(b.column(0)):
                high, low = (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                at = held.setdefault(x.shape[1], [0, 0])
                at[0] += len(rows)
                at[1] = at[1] + high * (1 << 32) + low
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_pydict(
                {"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([[Decimal(int(v)) for v in s]], pa.list_(pa.decimal128(38, 0)))}
            )

    parts = stored(fit.select("x").mapInArrow(run, "d int, n long, s array<decimal(38,0)>"), "sums")
    count = {r["d"]: r["n"] for r in parts.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    total = parts.select("d", F.posexplode("s").alias("i", "v")).groupBy("d", "i").agg(F.sum("v").alias("v")).collect()
    out = {d: (n, [0] * d) for d, n in count.items()}
    for r in total:
        out[r["d"]][1][r["i"]] = int(r["v"])
    return out


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _triangles(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The triangular factor R of the centred vectors of each size: one from each task, then merged in a tree."""
    kind = "d int, slot long, r binary"

    def table_of(d: int, slot: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "slot": pa.array([slot], pa.int64()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())})

    def local(batches):
        held: dict[int, np.ndarray] = {}
        slot = 0
        for b in batches:
            slot = b.column(1)[0].as_py() if b.num_rows else slot
            for _, x in _by_size(b.column(0)):
                d = x.shape[1]
                n, s = sums[d]
                for i in range(0, len(x), ROWS_AT_ONCE):
                    centred = _deviation(x[i : i + ROWS_AT_ONCE], n, s).astype(np.float64) / n
                    held[d] = _triangle(np.concatenate([held[d], centred]) if d in held else centred)
        for d, r in held.items():
            yield table_of(d, slot, r)

    def merge(key, group):
        d = key[0].as_py()
        found = [np.frombuffer(r, dtype=np.float64).reshape(-1, d) for r in group.column("r").to_pylist()]
        return pa.Table.from_batches([table_of(d, key[1].as_py(), _triangle(np.concatenate(found)))])

    level = stored(fit.select("x", F.spark_partition_id().cast("long").alias("slot")).mapInArrow(local, kind), "triangles")
    while (level.agg(F.max("slot")).first()[0] or 0) > 0:
        up = F.floor(F.col("slot") / FAN_IN)
        level = stored(level.withColumn("slot", up).groupBy("d", "slot").applyInArrow(merge, kind), "triangles")
    return {r["d"]: np.frombuffer(bytes(r["r"]), dtype=np.float64).reshape(-1, r["d"]) for r in level.collect()}


class Whitener:
    """What whitens vectors of one size: ``axes`` (a column for each component), ``scale`` (standard deviations), ``explained``."""

    def __init__(self, n: int, sums: list[int], triangle: np.ndarray, components: int):
        _, singular, right = np.linalg.svd(triangle)
        rank = int((singular > singular[:1].max(initial=0) * max(n, len(sums)) * np.finfo(float).eps).sum())
        kept = min(components, rank)
        axes = right[:kept].T
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)]) if kept else axes
        self.n, self.sums, self.axes = n, sums, axes
        self.scale = singular[:kept] / np.sqrt(n)
        self.explained = singular[:kept] ** 2 / max((singular**2).sum(), np.finfo(float).tiny)
        self.error = 0.0

    def __call__(self, deviation: np.ndarray) -> np.ndarray:
        return (deviation.astype(np.float64) / self.n) @ self.axes / self.scale


def _identity_errors(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by vector size."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _by_size(b.column(0)):
                m = models[x.shape[1]]
                y = m(_deviation(x, m.n, m.sums))
                y = np.concatenate([y, np.ones((len(y), 1))], axis=1)
                held[x.shape[1]] = held.get(x.shape[1], 0) + y.T @ y
        for d, s in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "s": pa.array([s.ravel().tolist()], pa.list_(pa.float64()))})

    rows = fit.select("x").mapInArrow(run, "d int, s array<double>").select("d", F.posexplode("s").alias("i", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in rows.groupBy("d", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["d"], {})[r["i"]] = r["v"]
    errors = {}
    for d, cells in found.items():
        k = models[d].axes.shape[1]
        s = np.array([cells[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / models[d].n
        errors[d] = float(np.abs(s[:k, :k] - np.outer(s[:k, k], s[:k, k]) - np.eye(k)).max(initial=0))
    return errors


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    TSQR: the distinct vectors are centred with exact sums, each task folds its rows into one triangle, triangles
    are merged in a tree, and the right singular vectors of the last one are the components. What passes through
    the driver is one triangle, so many numbers as the square of the dimension.

    Vectors that are null or hold null, NaN or infinite entries have no row; repeated rows and rows without an id
    each have theirs. Vectors of different sizes do not share a space: each size is whitened by itself. Components
    without variance (one distinct vector, constant dimensions, an empty vector) do not exist. ``deviation`` is
    null where it does not fit a long. Of two components with one variance either may come first. Other columns
    are not read.
    """
    kind = vectors.schema[id].dataType.simpleString()
    good = vectors.where(usable(F.col(vector))).select(F.col(id).alias("_id"), whole(F.col(vector)).alias("x"))
    fit = stored(good.select("x").distinct(), "vectors")
    sums = _sums(fit)
    triangles = _triangles(fit, sums)
    models = {d: Whitener(n, s, triangles[d], components) for d, (n, s) in sums.items() if d}
    for d, e in _identity_errors(fit, models).items():
        models[d].error = e

    def run(batches):
        for b in batches:
            for rows, x in _by_size(b.column(1)):
                m = models[x.shape[1]]
                away = _deviation(x, m.n, m.sums)
                k = m.axes.shape[1]
                if away.dtype == object or x.shape[1] * int(np.abs(away).max(initial=0)) ** 2 >= _LIMIT:
                    total = [v if v < 1 << 63 else None for v in (away.astype(object) ** 2).sum(axis=1).tolist()]
                else:
                    total = (away * away).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * k, m.n, dtype=np.int64)),
                        pa.array(total, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                        pa.array(m(away).ravel()),
                        pa.array(np.tile(m.explained, len(rows))),
                        pa.array(np.full(len(rows) * k, m.error)),
                    ],
                    names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = good.mapInArrow(run, f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("_id", id)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of ``embeddings`` on up to 16 whitened components of the distinct vectors."""
    return whitened(table(spark, sf_dir, "embeddings"))
