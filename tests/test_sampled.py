"""Groupings and detectors that are fitted on bounded samples."""

import numpy as np
import pytest

from tabulon.operators import anomaly, sampled_groups


def blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c, n in (((0, 0), 60), ((4, 0), 45), ((0, 5), 30))])
    return x, np.repeat([0, 1, 2], [60, 45, 30])


@pytest.mark.parametrize("find", [lambda x: sampled_groups.ward(x, 3), lambda x: sampled_groups.medoids(x, 3), lambda x: sampled_groups.dense(x, 10)])
def test_groups_are_found(find):
    x, truth = blobs()
    assert len(set(zip(truth.tolist(), find(x).tolist(), strict=True))) == 3


def test_other_rows_join(spark):
    x, truth = blobs()
    df = spark.createDataFrame([(k, float(a), float(b), int(t)) for k, ((a, b), t) in enumerate(zip(x, truth, strict=True))], "id long, a double, b double, t int")
    out = sampled_groups.sampled_groups(df, ["a", "b"], "id", "ward", 3, sample=90).join(df.select("id", "t"), "id")
    assert out.select("t", "cluster").distinct().count() == 3 and out.count() == 135


def test_one_class(spark):
    df = spark.sql("select id, case when id < 8 then 40.0 + id else sin(id) end as a, cos(id * 1.7) as b from range(400)")
    out = anomaly.one_class(df, ["a", "b"], "id").orderBy("one_class", ascending=False).limit(20)
    assert len({r["id"] for r in out.collect()} & set(range(8))) >= 6
