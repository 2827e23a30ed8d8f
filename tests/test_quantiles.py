"""Exact quantiles and distinct counts against NumPy, on hostile columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import quantiles, splits
from tabulon.sources.scratch import stored


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = 3000
    columns = {
        "normal": rng.standard_normal(n), "tail": np.exp(rng.standard_normal(n) * 8), "ties": rng.integers(0, 3, n) * 1.0, "hot": np.where(rng.random(n) < 0.9, 0.0, rng.random(n)),
        "huge": rng.choice([-1e308, 1e308, 5.0], n), "tiny": rng.random(n) * 1e-300, "one": np.full(n, 7.5),
    }
    rows = [tuple(float(x) for x in r) for r in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.951, 1.0]
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in columns}, shares)
    for c, x in columns.items():
        x = np.sort(x)
        for share, value in zip(shares, got[c], strict=True):
            at = (n - 1) * share
            low, high = x[int(np.floor(at))], x[int(np.ceil(at))]
            assert min(low, high) <= value <= max(low, high)
            if abs(low) < 1e300:
                assert value == pytest.approx(low + (high - low) * (at % 1), rel=1e-12, abs=0)
    assert quantiles.distinct_counts(df, {c: F.col(c) for c in columns}) == {c: len(np.unique(x)) for c, x in columns.items()}


def test_quantiles_of_odd_columns(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, None, inf, 3), (nan, None, -inf, 3), (None, None, 2.0, 4), (5.0, None, 3.0, None)], "a double, b double, c double, d int")
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in "abcd"}, [0.0, 0.5, 1.0])
    assert got == {"a": [1.0, 3.0, 5.0], "b": None, "c": [-inf, 2.5, inf], "d": [3.0, 3.0, 4.0]}
    assert quantiles.medians(df.limit(0), {"a": F.col("a")}) == {"a": None} and quantiles.exact_quantiles(df, {}, [0.5]) == {}
    assert quantiles.distinct_counts(df, {"b": F.col("b"), "d": F.col("d")}) == {"b": 0, "d": 2} and quantiles.distinct_counts(df, {}) == {}


def test_a_sentinel_does_not_fill_one_range(spark, monkeypatch):
    """One value far out: ranges still hold few rows each, and an answer outside of those looked at is found in a further pass."""
    df = spark.range(20_001).select(F.when(F.col("id") == 20_000, 1e18).otherwise(F.col("id").cast("double")).alias("x"))
    kept = []
    monkeypatch.setattr(quantiles, "stored", lambda t, name: kept.append(stored(t, name)) or kept[-1])
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5, 0.99]) == {"x": [10_000.0, 19_800.0]}
    assert kept[0].where("x is not null").count() < 1000 and kept[0].groupBy("b").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < 200
    monkeypatch.setattr(quantiles, "_near", lambda cuts, share: (cuts[0], cuts[0]))
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5, 0.99]) == {"x": [10_000.0, 19_800.0]}


def test_stratified_splits_of_a_hot_class(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 51 == 0, None).otherwise("hot").alias("y"))
    out = splits.holdout(df, "id", "y").collect()
    for y in ("rare", "hot", None):
        want = sorted((r["id"] for r in out if r["y"] == y), key=lambda i: __import__("hashlib").md5(f"{i}:42".encode()).hexdigest())
        assert {r["id"] for r in out if r["y"] == y and r["is_test"]} == set(want[: int(len(want) * 0.2)])
    folds = splits.folds(df, "id", 5, "y").groupBy("y", "fold").count().collect()
    for y in ("rare", "hot", None):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
