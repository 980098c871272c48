import math

import numpy as np
import pytest

from pelagos.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, components=16):
    """Whitening by the covariance's eigenvectors: what the tree of triangles must equal."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(e)[::-1][:components]
    away = x * n - s
    return n, (away**2).sum(axis=1), (away.astype(float) / n) @ axes[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def same(rows, vectors, ids):
    n, deviation, white, explained = plain(vectors)
    k = white.shape[1]
    assert len(rows) == len(ids) * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(k):
        mine = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-6
        for i, d in zip(ids, deviation, strict=True):
            r = got[i, c + 1]
            assert r["n"] == n and r["deviation"] == d and abs(r["explained"] / explained[c] - 1) < 1e-8 and r["identity_error"] < 1e-8


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = whitening.op13_embedding_whitening(spark, SF).collect()
    same(rows, [r["embedding"] for r in table], [r["vec_id"] for r in table])


def test_many_tasks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 5)) * [9, 7, 5, 3, 1] + [0, 1e4, -50, 3, 0]
    good = [(i, v.tolist(), 7) for i, v in enumerate(base)] + [(1000 + i, base[4].tolist(), 7) for i in range(150)]
    odd = [(2000, None, 1), (2001, [1.0, None, 2.0, 3.0, 4.0], 1), (2002, [math.nan] * 5, 1), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (2004, [], 1), (2005, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, component int").repartition(29)
    rows = whitening.whitened(df).collect()
    same(rows, [v for _, v, _ in good], [i for i, _, _ in good])


def test_sizes_repeats_and_nothing(spark):
    schema = "vec_id string, embedding array<float>"
    rows = [("a", [1.0, 2.0]), ("a", [1.0, 2.0]), (None, [3.0, 5.0]), ("b", [2.0, 9.0]), ("x", [1.0, 2.0, 3.0]), ("y", [4.0, 2.0, 3.0])]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == [("None", 1, 3), ("None", 2, 3), ("a", 1, 3), ("a", 1, 3), ("a", 2, 3), ("a", 2, 3), ("b", 1, 3), ("b", 2, 3), ("x", 1, 2), ("y", 1, 2)]
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0])] * 3, schema)).collect() == []
    huge = whitening.whitened(spark.createDataFrame([("a", [3e38, 1.0]), ("b", [-3e38, 2.0]), ("c", [0.0, 7.0])], schema)).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != "c"} == {None} and all(math.isfinite(r["whitened"]) for r in huge)


@pytest.mark.parametrize("shift", [0, 1e6])
def test_far_from_the_origin(spark, shift):
    rng = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 3)) + shift)]
    same(whitening.whitened(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect(), [v for _, v in vectors], range(200))
