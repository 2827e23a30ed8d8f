"""Models fitted in NumPy on bounded samples."""

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import capped, train


def table(spark, classes):
    x = [(F.col("id") * p % 101 / 50 - 1).cast("double") for p in (7, 13)]
    y = x[0] * 2 - x[1] * 0.5
    df = spark.range(300).select(F.col("id").alias("row_"), array_to_vector(F.array(*x)).alias("features"), ((y > 0).cast("double") if classes else y).alias("label"))
    return df


@pytest.mark.parametrize("key", ["knn", "svm", "bayesian_ridge", "theil_sen", "ransac", "kernel_ridge", "pls", "mlp_regressor", "gaussian_process", "adaboost"])
def test_regressors(spark, key):
    df = table(spark, False)
    out = train.make(key, "regression", 0, 2).fit(df).transform(df)
    assert train.measure(out, "regression", 0)["r2"] > 0.8


@pytest.mark.parametrize("key", ["knn", "svm", "adaboost", "gaussian_process"])
def test_classifiers(spark, key):
    df = table(spark, True)
    out = train.make(key, "classification", 2, 2).fit(df).transform(df)
    found = train.measure(out, "classification", 2)
    assert found["accuracy"] > 0.85 and found["roc_auc"] > 0.9


def test_oversampling(spark):
    df = table(spark, False).select(F.when(F.col("row_") < 60, 1.0).otherwise(0.0).alias("label"), "features")
    out = capped.oversample(df)
    n = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert n[0.0] == 240 and 200 <= n[1.0] <= 280
    assert out.where(F.size(vector_to_array("features")) != 2).count() == 0
