"""Nearest neighbours and what is built on them, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.operators import anomaly, neighbours


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "i long, x array<double>")


def brute(q, p, k, apart):
    """Ids of the k nearest by (distance, id)."""
    out = []
    for i, r in enumerate(q):
        d = np.sqrt(((p - r) ** 2).sum(1))
        order = np.lexsort((np.arange(len(p)), d))
        out.append([(int(j), float(d[j])) for j in order if not (apart and j == i)][:k])
    return out


def same(got, want):
    for r in got:
        mine = [(n["id"], n["d"]) for n in r["near"]]
        assert [i for i, _ in mine] == [i for i, _ in want[r["i"]]], r["i"]
        assert np.allclose([d for _, d in mine], [d for _, d in want[r["i"]]])
    assert len(got) == len(want)


@pytest.mark.parametrize("shape", ["even", "hot", "grid", "line", "wide", "few"])
def test_nearest_rows(spark, shape):
    rng = np.random.default_rng(len(shape))
    x = {
        "even": lambda: rng.random((900, 2)),
        # a third of all rows are one point, a third lie closely together
        "hot": lambda: np.concatenate([np.full((300, 3), 0.5), 0.5 + 1e-4 * rng.standard_normal((300, 3)), 10 * rng.random((300, 3))]),
        "grid": lambda: rng.integers(0, 12, (900, 2)).astype(float),
        "line": lambda: np.column_stack([np.arange(700) ** 2.0, np.zeros(700)]),
        "wide": lambda: rng.standard_normal((500, 12)),
        "few": lambda: rng.random((3, 2)),
    }[shape]()
    got = neighbours.nearest_rows(frame(spark, x), "i", F.col("x"), x.shape[1], 7, per_cell=40).collect()
    same(got, brute(x, x, 7, True))


def test_nearest_of_others(spark):
    rng = np.random.default_rng(4)
    p, q = rng.random((600, 3)), np.concatenate([rng.random((200, 3)) * 3 - 1, np.full((100, 3), 0.25)])
    points = frame(spark, p).withColumnRenamed("i", "id")
    same(neighbours.nearest_rows(frame(spark, q), "i", F.col("x"), 3, 5, points=points, per_cell=30).collect(), brute(q, p, 5, False))
    assert neighbours.nearest_rows(frame(spark, q).limit(0), "i", F.col("x"), 3, 5, points=points).count() == 0
    assert [r["near"] for r in neighbours.nearest_rows(frame(spark, q[:1]), "i", F.col("x"), 3, 5).collect()] == [[]]


def test_cells_bound_what_rows_meet(spark):
    """In two dimensions a row visits a few of many cells."""
    x = np.random.default_rng(6).random((20_000, 2))
    points = frame(spark, x).withColumnRenamed("i", "key")
    cells = neighbours.Cells(points, 2, per_cell=200)
    met = []
    held = cells._meet
    cells._meet = lambda queries, k, apart: met.append(queries.count()) or held(queries, k, apart)
    out = cells.nearest(points, 5, True)
    assert out.count() == 20_000 and len(cells.pivots) == 100 and met[0] == 20_000 and met[1] < 2 * 20_000


def test_lof_over_all_rows(spark):
    """More rows than any sample would hold; some are planted far out."""
    rng = np.random.default_rng(8)
    n, k = 20_000, 10
    x = np.concatenate([rng.standard_normal((n - 20, 2)), rng.standard_normal((20, 2)) * 0.5 + 12])
    x[-5:] += rng.random((5, 2)) * 20
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    got = np.zeros(n)
    for r in anomaly.local_outlier_factor(df, ["a", "b"], "i", k).collect():
        got[r["i"]] = r["lof"]
    z = (x - x.mean(0)) / x.std(0)
    near, dist = np.zeros((n, k), int), np.zeros((n, k))
    for low in range(0, n, 500):
        d = np.sqrt(((z[low : low + 500, None] - z[None]) ** 2).sum(2))
        d[np.arange(len(d)), low + np.arange(len(d))] = np.inf
        at = np.argpartition(d, k, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, at, 1), 1)
        near[low : low + 500] = np.take_along_axis(at, order, 1)
        dist[low : low + 500] = np.take_along_axis(d, near[low : low + 500], 1)
    density = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    assert np.allclose(got, density[near].mean(1) / density, rtol=1e-6)
    assert set(np.argsort(-got)[:3]) <= set(range(n - 20, n))


def test_tables_of_distances_stay_small(monkeypatch):
    """However many pivots there are, a task holds no more than BLOCK distances at once."""
    sizes, squares = [], neighbours._squares
    monkeypatch.setattr(neighbours, "_squares", lambda a, b: sizes.append(len(a) * len(b)) or squares(a, b))
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5000, 2))

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x))], names=["key", "x"])
            return pa.Table.from_batches(list(run([batch])))

    cells = neighbours.Cells.__new__(neighbours.Cells)
    cells.width, cells.pivots = 2, rng.standard_normal((neighbours.PIVOTS, 2))
    got = cells._assigned(Rows())
    assert max(sizes) <= neighbours.BLOCK and got.num_rows == 5000
    assert got["cell"].to_pylist()[:200] == [int(((cells.pivots - v) ** 2).sum(1).argmin()) for v in x[:200]]
