"""Training: tasks, a registry of models on pyspark.ml, comparison by cross-validation, scoring and tuning."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import metrics as M
from tabulon.functions.values import category, number
from tabulon.operators import capped, drift
from tabulon.operators.capped import Capped
from tabulon.operators.encode import Encoding, fit_auto
from tabulon.operators.neighbours import Nearest
from tabulon.operators.profile import NUMERIC, kind_of_type
from tabulon.operators.splits import folds
from tabulon.sources.writers import plain

CLASSIFICATION, REGRESSION = "classification", "regression"
#: Rows of a partition of the table that models are fitted on, about.
ROWS = 50_000


def infer_task(df: DataFrame, target: str) -> str:
    """Classification or regression, by the target's type and values, from one aggregation."""
    kind = kind_of_type(dict(df.dtypes)[target])
    if kind == "date":
        raise ValueError("a date can't be a target; a forecast may be meant")
    if kind == "boolean":
        return CLASSIFICATION
    x = F.col(target).cast("double") if kind == "number" else number(F.col(target))
    row = df.agg(F.count(target).alias("n"), F.count(x).alias("m"), F.count_distinct(x).alias("u"), F.bool_and(x == F.floor(x)).alias("whole")).first()
    if kind == "text":
        return REGRESSION if row["n"] and row["m"] / row["n"] >= 0.95 and row["u"] > 10 else CLASSIFICATION
    return CLASSIFICATION if row["u"] == 2 or row["whole"] and row["u"] <= 10 else REGRESSION


def infer_tasks(df: DataFrame, targets: list[str]) -> str:
    if len(targets) == 1:
        return infer_task(df, targets[0])
    row = df.agg(*[F.count_distinct(t).alias(t) for t in targets]).first()
    if all(row[t] == 2 for t in targets):
        return "multilabel"
    if all(kind_of_type(dict(df.dtypes)[t]) == "number" for t in targets):
        return "multi-regression"
    raise ValueError("several targets are all two-valued or all numeric")


def class_text(df: DataFrame, target: str):  # noqa: ANN201
    """(the class of a row as text, the target's type): booleans read True and False, whole numbers lose their decimals."""
    kind = dict(df.dtypes)[target]
    x = F.col(target)
    return (F.initcap(x.cast("string")) if kind == "boolean" else category(x, kind) if kind in NUMERIC or kind.startswith("decimal") else F.trim(x)), kind


def prepare_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str]]:
    """df with label, a double, of rows with a usable target, and the classes in the order of their numbers."""
    rows = df.where(F.col(target).isNotNull())
    if task == REGRESSION:
        x = number(F.col(target)) if dict(df.dtypes)[target] == "string" else F.col(target).cast("double")
        return rows.withColumn("label", x).where("label is not null"), []
    text, _ = class_text(df, target)
    counts = rows.groupBy(text.alias("c")).count().where("count >= 2").collect()
    classes = sorted(r["c"] for r in counts)
    if len(classes) < 2:
        raise ValueError("the target has one class only")
    if len(classes) > 1000:
        raise ValueError("the target has over 1000 classes")
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), text) - 1
    return rows.withColumn("label", label.cast("double")).where("label >= 0"), classes


@dataclass(frozen=True)
class Spec:
    """A kind of model: its tasks, how to make it, whether it is quick, and up to how many rows it is offered."""

    key: str
    tasks: tuple[str, ...]
    make: Callable[[str, int], object]
    tier: str = "default"
    quick: bool = False
    cap: int | None = None
    note: str = ""
    grid: dict[str, list] = field(default_factory=dict)


def _both(c: Callable, r: Callable) -> Callable[[str, int], object]:
    return lambda task, k: c(k) if task == CLASSIFICATION else r()


def _one_vs_rest(make: Callable[[], object]) -> Callable[[int], object]:
    return lambda k: make() if k == 2 else C.OneVsRest(classifier=make())


BOTH = (CLASSIFICATION, REGRESSION)
SPECS: dict[str, Spec] = {
    s.key: s
    for s in (
        Spec("baseline", BOTH, lambda task, k: "baseline", quick=True),
        Spec("linear", BOTH, _both(lambda k: C.LogisticRegression(regParam=1e-4), lambda: R.LinearRegression(regParam=0.0)), quick=True, grid={"regParam": [0.0, 1e-3, 1e-2, 0.1]}),
        Spec("ridge", BOTH, _both(lambda k: C.LogisticRegression(regParam=0.1), lambda: R.LinearRegression(regParam=0.1, elasticNetParam=0.0)), quick=True, grid={"regParam": [1e-3, 1e-2, 0.1, 1.0, 10.0]}),
        Spec("lasso", (REGRESSION,), lambda task, k: R.LinearRegression(regParam=0.01, elasticNetParam=1.0), grid={"regParam": [1e-3, 1e-2, 0.1]}),
        Spec("elasticnet", (REGRESSION,), lambda task, k: R.LinearRegression(regParam=0.01, elasticNetParam=0.5), grid={"elasticNetParam": [0.1, 0.5, 0.9]}),
        Spec("nb", (CLASSIFICATION,), lambda task, k: C.NaiveBayes(modelType="gaussian"), quick=True),
        Spec("tree", BOTH, _both(lambda k: C.DecisionTreeClassifier(maxDepth=30, minInstancesPerNode=2), lambda: R.DecisionTreeRegressor(maxDepth=30, minInstancesPerNode=2)), quick=True, grid={"maxDepth": [3, 5, 8, 12, 30]}),
        Spec("rf", BOTH, _both(lambda k: C.RandomForestClassifier(numTrees=50, maxDepth=8), lambda: R.RandomForestRegressor(numTrees=50, maxDepth=8)), quick=True, grid={"numTrees": [20, 50, 100], "maxDepth": [5, 8, 12]}),
        Spec("extratrees", BOTH, _both(lambda k: C.RandomForestClassifier(numTrees=50, maxDepth=8, bootstrap=False, featureSubsetStrategy="sqrt"), lambda: R.RandomForestRegressor(numTrees=50, maxDepth=8, bootstrap=False, featureSubsetStrategy="onethird")), note="a forest without resampling stands in for random cuts"),
        Spec("gbm", BOTH, _both(_one_vs_rest(lambda: C.GBTClassifier(maxIter=30)), lambda: R.GBTRegressor(maxIter=30)), grid={"maxIter": [20, 50], "stepSize": [0.05, 0.1]}),
        Spec("histgb", BOTH, _both(_one_vs_rest(lambda: C.GBTClassifier(maxIter=30, maxBins=64)), lambda: R.GBTRegressor(maxIter=30, maxBins=64)), quick=True),
        Spec("mlp", (CLASSIFICATION,), lambda task, k: C.MultilayerPerceptronClassifier(layers=[0, 64, 32, k]), grid={"maxIter": [50, 100]}),
        Spec("huber", (REGRESSION,), lambda task, k: R.LinearRegression(loss="huber")),
        Spec("bagging", BOTH, _both(lambda k: C.RandomForestClassifier(numTrees=50, featureSubsetStrategy="all"), lambda: R.RandomForestRegressor(numTrees=50, featureSubsetStrategy="all")), tier="extra"),
        Spec("sgd", BOTH, _both(lambda k: C.LogisticRegression(maxIter=20), lambda: R.LinearRegression(maxIter=20)), tier="extra", note="full-gradient steps stand in"),
        Spec("linear_svm", (CLASSIFICATION,), lambda task, k: _one_vs_rest(lambda: C.LinearSVC(regParam=1e-3))(k), tier="extra"),
        Spec("lda", (CLASSIFICATION,), lambda task, k: Discriminant(shared=True), quick=True),
        Spec("qda", (CLASSIFICATION,), lambda task, k: Discriminant(shared=False), tier="extra"),
        Spec("knn", BOTH, lambda task, k: Nearest(k)),
        Spec("svm", BOTH, lambda task, k: Capped(capped.fourier_machine, k, 20_000), cap=20_000, note="approximate: random Fourier features"),
        Spec("bayesian_ridge", (REGRESSION,), lambda task, k: Capped(capped.bayesian_ridge, 0, 20_000), quick=True, note="fitted on up to 20,000 rows"),
        Spec("adaboost", BOTH, lambda task, k: Capped(capped.boosted_stumps, k, 5_000), tier="extra", note="fitted on up to 5,000 rows"),
        Spec("gaussian_process", BOTH, lambda task, k: Capped(capped.gaussian_process, k, 2_000), tier="extra", cap=2_000),
        Spec("theil_sen", (REGRESSION,), lambda task, k: Capped(capped.theil_sen, 0, 10_000), tier="extra", cap=10_000),
        Spec("ransac", (REGRESSION,), lambda task, k: Capped(capped.ransac, 0, 20_000), tier="extra", note="fitted on up to 20,000 rows"),
        Spec("kernel_ridge", (REGRESSION,), lambda task, k: Capped(capped.kernel_ridge, 0, 4_000), tier="extra", cap=10_000, note="fitted on up to 4,000 rows"),
        Spec("pls", (REGRESSION,), lambda task, k: Capped(capped.partial_least_squares, 0, 20_000), tier="extra", note="fitted on up to 20,000 rows"),
        Spec("mlp_regressor", (REGRESSION,), lambda task, k: Capped(capped.network, 0, 5_000), note="fitted on up to 5,000 rows"),
        Spec("poisson", (REGRESSION,), lambda task, k: R.GeneralizedLinearRegression(family="poisson", link="log"), tier="extra", note="targets of 0 or more"),
        Spec("gamma", (REGRESSION,), lambda task, k: R.GeneralizedLinearRegression(family="gamma", link="log"), tier="extra", note="positive targets"),
        Spec("tweedie", (REGRESSION,), lambda task, k: R.GeneralizedLinearRegression(family="tweedie", variancePower=1.5), tier="extra", note="targets of 0 or more"),
    )
}
#: Models of optional packages that aren't here, with the reason given when they are asked for.
ABSENT = {"xgboost": "needs the package xgboost", "lightgbm": "needs the package lightgbm", "catboost": "needs the package catboost", "torch": "needs the package torch"}


class Discriminant:
    """Gaussian discriminant analysis in closed form: class means and covariances from one aggregation of outer products."""

    def __init__(self, shared: bool, shrink: float = 0.1) -> None:
        self.shared, self.shrink = shared, shrink

    def fit(self, df: DataFrame) -> Discriminant:
        rows = df.select("label", vector_to_array("features").alias("x"))

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[float, np.ndarray] = {}
            for part in parts:
                for y, own in part.groupby("label")["x"]:
                    x = np.column_stack([np.ones(len(own)), np.array(own.tolist(), float).reshape(len(own), -1)])
                    total[y] = total.get(y, 0) + x.T @ x
            for y, m in total.items():
                yield pd.DataFrame({"label": y, "at": np.arange(m.size), "v": m.ravel()})

        # the products of all pairs of columns, and of each with 1, summed in each partition before they move
        got = rows.mapInPandas(sums, "label double, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).toPandas().sort_values(["label", "at"])
        square = np.stack([part["v"].to_numpy() for _, part in got.groupby("label")])
        wide = math.isqrt(square.shape[1])
        square = square.reshape(len(square), wide, wide)
        n, width = square[:, 0, 0], wide - 1
        means = square[:, 0, 1:] / n[:, None]
        covs = square[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
        if self.shared:
            covs[:] = (covs * n[:, None, None]).sum(0) / n.sum()
        eye = np.eye(width)
        covs = (1 - self.shrink) * covs + self.shrink * eye * np.trace(covs, axis1=1, axis2=2)[:, None, None] / max(1, width) + 1e-9 * eye
        self.prior, self.means, self.inverse = np.log(n / n.sum()), means, np.linalg.inv(covs)
        self.logdet = np.linalg.slogdet(covs)[1]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        scores = []
        for k in range(len(self.prior)):
            # x'Ax expanded into a quadratic and a linear part of the row
            a, m = self.inverse[k], self.means[k]
            lin, const = a @ m, float(m @ a @ m)
            quad, dot = _quadratic(a), _dot(F.col("_x"), lin)
            scores.append(F.lit(float(self.prior[k] - self.logdet[k] / 2)) - 0.5 * (quad - 2 * dot + F.lit(const)))
        out = df.withColumn("_x", x).withColumn("_s", F.array(*scores))
        top = F.array_max("_s")
        e = F.transform("_s", lambda s: F.exp(s - top))
        p = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        return out.withColumn("probability", array_to_vector(p)).withColumn("prediction", (F.array_position("_s", top) - 1).cast("double")).drop("_x", "_s")


def _dot(x, weights: np.ndarray):  # noqa: ANN001, ANN202
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, map(float, weights))), lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)


def _quadratic(a: np.ndarray):  # noqa: ANN202
    """x'Ax of the array _x."""
    rows = F.array(*[F.col("_x")[i] * _dot(F.col("_x"), row) for i, row in enumerate(a)])
    return F.aggregate(rows, F.lit(0.0), lambda s, u: s + u)


class Baseline:
    """The mean, or the commonest class with the class shares as probabilities."""

    def __init__(self, task: str, classes: int) -> None:
        self.task, self.classes = task, classes

    def fit(self, df: DataFrame) -> Baseline:
        if self.task == REGRESSION:
            self.value = df.agg(F.avg("label")).first()[0]
        else:
            n = {int(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
            total = sum(n.values()) or 1
            self.shares = [n.get(k, 0) / total for k in range(self.classes)]
            self.value = float(max(range(self.classes), key=lambda k: (self.shares[k], -k)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("prediction", F.lit(float(self.value)))
        if self.task == REGRESSION:
            return out
        return out.withColumn("probability", array_to_vector(F.array(*map(F.lit, self.shares))))


def select_models(task: str, rows: int, names: list[str] | None = None, quick: bool = False) -> tuple[list[str], dict[str, str]]:
    """Keys of the models to try, and why others that were asked for are not."""
    skipped: dict[str, str] = {}
    if names:
        for n in names:
            if n in ABSENT:
                skipped[n] = ABSENT[n]
            elif n not in SPECS:
                raise ValueError(f"no model {n!r}; there are {', '.join(SPECS)}")
    wanted = [n for n in names if n in SPECS] if names else [k for k, s in SPECS.items() if s.tier == "default" and (s.quick or not quick)]
    out = []
    for n in wanted:
        s = SPECS[n]
        if task not in s.tasks:
            skipped[n] = f"not for {task}"
        elif s.cap and rows > s.cap:
            skipped[n] = f"for up to {s.cap} rows"
        else:
            out.append(n)
    return out, skipped


def make(key: str, task: str, classes: int, width: int, params: dict | None = None):  # noqa: ANN201
    spec = SPECS[key]
    model = spec.make(task, classes)
    if model == "baseline":
        return Baseline(task, classes)
    if key == "mlp":
        model.setLayers([width, 64, 32, classes])
    if params:
        target = model.getClassifier() if isinstance(model, C.OneVsRest) else model
        target.setParams(**params)
    return model


def measure(scored: DataFrame, task: str, classes: int) -> dict[str, float]:
    """All metrics of a scored table with label and prediction (and probability)."""
    if task == REGRESSION:
        r = M.regression(scored, "label", "prediction").first()
        return {k: r[k] for k in ("rmse", "mae", "r2", "mape")}
    out = M.classification(scored, "label", "prediction").first().asDict()
    if classes > 2 and "probability" in scored.columns:
        # each class against the others, weighed by its rows
        p = scored.select("label", vector_to_array("probability").alias("p"))
        rows = [(r["label"], r["count"]) for r in p.groupBy("label").count().collect()]
        auc = {y: M.ranking(p.select((F.col("label") == y).cast("int").alias("y"), F.col("p")[int(y)].alias("s"))).first()["roc_auc"] for y, _ in rows}
        known = [(auc[y], n) for y, n in rows if auc[y] is not None]
        out["roc_auc"] = sum(a * n for a, n in known) / max(1, sum(n for _, n in known)) if known else None
        own = F.element_at("p", F.col("label").cast("int") + 1)
        out["log_loss"] = p.agg(F.avg(-F.ln(F.greatest(own, F.lit(1e-15))))).first()[0]
    if classes == 2 and "probability" in scored.columns:
        p = scored.select(F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("s"))
        out |= {"roc_auc": M.ranking(p).first()["roc_auc"], "log_loss": p.agg(M.log_loss(F.col("y"), F.col("s"))).first()[0]}
    return out


def shares_of(scored: DataFrame, classes: int):  # noqa: ANN201
    """The class probabilities of a scored row as an array; certain where a model gives none."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    return F.array(*[(F.col("prediction") == k).cast("double") for k in range(classes)])


def _parts(models: list, df: DataFrame, classes: int) -> DataFrame:
    """df with _m<n>: an array of what each model says of a row, class shares or its prediction."""
    for n, m in enumerate(models):
        scored = m.transform(df)
        df = scored.select(*df.columns, (shares_of(scored, classes) if classes else F.array("prediction")).alias(f"_m{n}"))
    return df


class Averaged:
    """The mean of several fitted models' class shares or predictions."""

    def __init__(self, models: list, classes: int) -> None:
        self.models, self.classes = models, classes

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"_m{n}" for n in range(len(self.models))]
        total = F.col(names[0])
        for c in names[1:]:
            total = F.zip_with(total, F.col(c), lambda a, b: a + b)
        out = _parts(self.models, df, self.classes).withColumn("_p", F.transform(total, lambda v: v / len(names))).drop(*names)
        if not self.classes:
            return out.withColumn("prediction", F.col("_p")[0]).drop("_p")
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_p")).drop("_p")


class Stacked:
    """A linear model over what several fitted models say, learned from their out-of-fold answers."""

    def __init__(self, models: list, top: object, classes: int) -> None:
        self.models, self.top, self.classes = models, top, classes

    def transform(self, df: DataFrame) -> DataFrame:
        return self.top.transform(said(self.models, df, self.classes))


def said(models: list, df: DataFrame, classes: int) -> DataFrame:
    """df whose features are what the models say of a row."""
    names = [f"_m{n}" for n in range(len(models))]
    out = _parts(models, df, classes).withColumn("features", array_to_vector(F.concat(*names) if len(names) > 1 else F.col(names[0])))
    return out.drop(*names)


def _top(classes: int):  # noqa: ANN202
    return C.LogisticRegression(regParam=1e-3) if classes else R.LinearRegression(regParam=1e-3)


@dataclass
class Trained:
    task: str
    classes: list[str]
    encoding: Encoding
    model: object
    key: str
    leaderboard: list[dict]
    metric: str
    skipped: dict[str, str]
    threshold: float | None = None
    log_target: bool = False
    summary: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """df's columns with predicted, and for classes confidence (of the answer) and probability_<class>."""
        keep = df.columns if keep is None else keep
        scored = self.scored(df, keep)
        if self.task == REGRESSION:
            return scored.select(*keep, F.col("prediction").alias("predicted"))
        names = F.array(*[F.lit(c) for c in self.classes])
        at = F.col("prediction").cast("int") + 1
        out = [F.element_at(names, at).alias("predicted")]
        if "probability" in scored.columns:
            p = vector_to_array("probability")
            out += [F.bround(F.element_at(p, at), 4).alias("confidence"), *[F.bround(p[k], 4).alias(f"probability_{c}") for k, c in enumerate(self.classes)]]
        return scored.select(*keep, *out)

    def scored(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep with prediction, in the target's own unit and by the chosen threshold, and probability."""
        out = self.model.transform(self.encoding.vectors(df, keep))
        if self.log_target:
            out = out.withColumn("prediction", F.expm1("prediction"))
        if self.threshold is not None:
            out = out.withColumn("prediction", (vector_to_array("probability")[1] >= self.threshold).cast("double"))
        return out

    def warning(self, df: DataFrame, least: int = 30) -> str | None:
        """A line for a prediction's output if the rows, least or more, differ much from those trained on."""
        if not self.summary or df.limit(least).count() < least:
            return None
        bad = sorted(r["column"] for r in drift.against(self.summary, df).where("status in ('major', 'missing')").collect())
        return f"these columns differ much from the training data: {', '.join(bad)}" if bad else None


def weighted(df: DataFrame) -> DataFrame:
    """df with weight: rows over classes times the rows of the label's class."""
    n = {int(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
    total = sum(n.values())
    of = F.array(*[F.lit(total / (len(n) * n[k]) if k in n else 0.0) for k in range(max(n, default=0) + 1)])
    return df.withColumn("weight", F.element_at(of, F.col("label").cast("int") + 1))


def _fit(model, rows: DataFrame, weights: bool, smote: bool):  # noqa: ANN001, ANN202
    """The model fitted on label and features; weights where it takes them, made rows of rarer classes with smote."""
    if smote:
        rows = capped.oversample(rows)
    elif weights:
        inner = model.getClassifier() if isinstance(model, C.OneVsRest) else model
        if hasattr(inner, "setWeightCol"):
            rows = weighted(rows)
            model = model.setWeightCol("weight") if not isinstance(model, C.OneVsRest) else model.setWeightCol("weight")
    return model.fit(rows)


def spread(df: DataFrame, row_id: str, rows: int) -> DataFrame:
    """df dealt by row_id to a partition for each ROWS rows; a small table stays as it is.

    Files of few bytes may hold many rows: read as they lie, or joined by adaptive execution, they'd be one task's.
    """
    return df if rows <= ROWS else df.repartition(-(-rows // ROWS), row_id)


def train(df: DataFrame, target: str, row_id: str, models: list[str] | None = None, quick: bool = True, k: int = 3, metric: str | None = None, encoding: Encoding | None = None, class_weights: bool = False, smote: bool = False, log_target: bool = False, threshold: bool = False, combine: bool = False) -> Trained:
    """Compare models by k-fold cross-validation and fit the best on all rows.

    Folds are a hash of row_id, for classes of nearly equal size in each class, so every model sees the same ones. The
    encoding's columns are chosen once (encoding, or by their kinds); what it learns of them is learned anew in each fold
    from the rows that are trained on. class_weights weighs classes evenly where a model takes weights; smote makes rows of
    rarer classes in the rows that are trained on; log_target fits log(1 + target); threshold chooses, for two classes, the
    probability from which on to answer yes, by F1 over out-of-fold probabilities; combine lists the mean and a linear
    stack of the three best models as ensemble and stacking.
    """
    size = df.count()
    df = spread(df, row_id, size)
    dealt = [df.persist()] if size > ROWS else []  # a small table is the caller's own, cached or not
    task = infer_task(df, target)
    rows, classes = prepare_target(df, target, task)
    if log_target:
        if task != REGRESSION or rows.agg(F.min("label")).first()[0] <= -1:
            raise ValueError("a log target is a number above -1")
        rows = rows.withColumn("label", F.log1p("label"))
    n_classes = len(classes)
    known = encoding or fit_auto(rows.drop("label", row_id), target)
    metric = M.metric_name(metric or ("f1_macro" if task == CLASSIFICATION else "rmse"))
    if task == CLASSIFICATION:
        k = max(2, min(k, rows.groupBy("label").count().agg(F.min("count")).first()[0] or k))
    inputs = [c for c in known.inputs() if c not in (row_id, "label")]
    base = folds(rows.select(row_id, "label", *[F.col(f"`{c}`") for c in inputs if c in rows.columns]), row_id, k, "label" if task == CLASSIFICATION else None)
    base = (spread(base, row_id, size) if task == CLASSIFICATION else base).persist()
    n = base.count()
    keys, skipped = select_models(task, n, models, quick)
    smote = smote and task == CLASSIFICATION
    results: dict[str, dict] = {key: {"scores": [], "seconds": 0.0, "error": None, "models": []} for key in keys}
    tests = []
    for f in range(k):
        part = known.refit(base.where(F.col("fold") != f))
        fit_on = part.vectors(base.where(F.col("fold") != f), ["label"]).persist()
        test = part.vectors(base.where(F.col("fold") == f), [row_id, "label", "fold"]).persist()
        tests.append(test)
        for key in keys:
            r, began = results[key], time.time()
            if r["error"] is None:
                try:
                    model = _fit(make(key, task, n_classes, len(part.columns())), fit_on, class_weights and task == CLASSIFICATION, smote)
                    r["scores"].append(measure(_unlogged(model.transform(test), log_target), task, n_classes)[metric])
                    r["models"].append(model)
                except Exception as e:  # noqa: BLE001  a model that can't be fitted is listed with the reason
                    r["error"] = str(e)[:200]
            r["seconds"] += time.time() - began
        fit_on.unpersist()
    row_of = lambda key, r: {"model": key, "score": float(np.mean(r["scores"])) if r["error"] is None else None, "std": float(np.std(r["scores"])) if r["error"] is None else None, "seconds": r["seconds"], "error": r["error"]}
    higher = M.HIGHER_IS_BETTER[metric]
    board = ordered([row_of(key, r) for key, r in results.items()], higher)
    best3 = [r["model"] for r in board if r["error"] is None and r["model"] != "baseline"][:3]
    stack = None
    if combine and len(best3) > 1:
        mixes = [[results[key]["models"][f] for key in best3] for f in range(k)]
        answers = reduce(DataFrame.unionByName, [said(mixes[f], tests[f], n_classes) for f in range(k)]).persist()
        for key in ("ensemble", "stacking"):
            began, scores = time.time(), []
            for f in range(k):
                if key == "ensemble":
                    out = Averaged(mixes[f], n_classes).transform(tests[f])
                else:
                    out = _top(n_classes).fit(answers.where(F.col("fold") != f)).transform(answers.where(F.col("fold") == f))
                scores.append(measure(_unlogged(out, log_target), task, n_classes)[metric])
            board.append(row_of(key, {"scores": scores, "seconds": time.time() - began, "error": None}))
        stack = _top(n_classes).fit(answers)
        board = ordered(board, higher)
    if not board or board[0]["score"] is None:
        raise ValueError("no model could be fitted: " + "; ".join(f"{r['model']}: {r['error']}" for r in board) + "; ".join(f"{a}: {b}" for a, b in skipped.items()))
    best = board[0]["model"]
    final = known.refit(base)
    table = final.vectors(base, ["label"]).persist()
    again = lambda key: _fit(make(key, task, n_classes, len(final.columns())), table, class_weights and task == CLASSIFICATION, smote)
    if best in ("ensemble", "stacking"):
        parts = [again(key) for key in best3]
        model = Averaged(parts, n_classes) if best == "ensemble" else Stacked(parts, stack, n_classes)
    else:
        model = again(best)
    cut = None
    if threshold and n_classes == 2:
        of = lambda f: Averaged(mixes[f], n_classes) if best == "ensemble" else results[best]["models"][f]
        if best == "stacking":
            held = stack.transform(answers)
        else:
            held = reduce(DataFrame.unionByName, [out.select("label", shares_of(out, 2)[1].alias("s")) for out in (of(f).transform(tests[f]) for f in range(k))]).select("label", "s")
        held = held if "s" in held.columns else held.select("label", vector_to_array("probability")[1].alias("s"))
        cut = best_threshold(held, "label", "s") if "probability" in model.transform(table.limit(1)).columns else None
    numbers = [c for c in final.numeric if c not in final.formats]
    summary = drift.summarise(base, numbers, list(final.categories))
    for t in (*dealt, base, table, *tests):
        t.unpersist()
    return Trained(task, classes, final, model, best, board, metric, skipped, cut, log_target, summary)


def _unlogged(scored: DataFrame, log_target: bool) -> DataFrame:
    return scored.withColumns({"label": F.expm1("label"), "prediction": F.expm1("prediction")}) if log_target else scored


@dataclass
class TrainedMany:
    """A model for each of several targets, all two-valued or all numeric."""

    task: str
    models: dict[str, Trained]

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """df's columns with predicted_<target>, and confidence_<target> where a model gives one."""
        keep = list(df.columns if keep is None else keep)
        out, names = df, list(keep)
        for target, m in self.models.items():
            scored = m.predict(out)
            new = {c: f"{c}_{target}" for c in ("predicted", "confidence") if c in scored.columns and c not in out.columns}
            out = scored.select(*[F.col(f"`{c}`") for c in out.columns], *[F.col(c).alias(n) for c, n in new.items()])
            names += new.values()
        return out.select(*[F.col(f"`{c}`") for c in names])

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        """For labels the multilabel metrics; for numbers each target's, by <target>_<metric>, and their means."""
        out = self.predict(df)
        if self.task == "multilabel":
            pairs = []
            for t, m in self.models.items():
                truth, _ = class_text(df, t)
                out = out.withColumns({f"_y_{t}": (truth == m.classes[1]).cast("int"), f"_p_{t}": (F.col(f"predicted_{t}") == m.classes[1]).cast("int")})
                pairs.append((f"_y_{t}", f"_p_{t}"))
            known = out.dropna(subset=[y for y, _ in pairs])
            return M.multilabel(known, pairs).first().asDict()
        found: dict[str, float] = {}
        for t in self.models:
            r = M.regression(out.where(F.col(t).isNotNull()), t, f"predicted_{t}").first()
            found |= {f"{t}_{name}": r[name] for name in ("rmse", "mae", "r2")}
        for name in ("rmse", "mae", "r2"):
            found[name] = sum(found[f"{t}_{name}"] for t in self.models) / len(self.models)
        return found


def train_many(df: DataFrame, targets: list[str], row_id: str, **options: object) -> TrainedMany:
    """train() for each of several targets, none of which is an input of another's model."""
    task = infer_tasks(df, targets)
    if len(targets) < 2:
        raise ValueError("several targets are needed")
    others = {t: df.drop(*[o for o in targets if o != t]) for t in targets}
    return TrainedMany(task, {t: train(rows, t, row_id, **options) for t, rows in others.items()})


def ordered(board: list[dict], higher: bool) -> list[dict]:
    """Best score first, then the smaller spread, then the faster; models without a score last."""
    sign = -1 if higher else 1
    return sorted(board, key=lambda r: (r["score"] is None, sign * (r["score"] or 0), r["std"] or 0, r["seconds"]))


def tune(df: DataFrame, key: str, task: str, classes: int, width: int, metric: str, trials: int = 10, k: int = 3, seed: int = 42) -> list[dict]:
    """Seeded random search over a model's grid; df has label, features and fold."""
    grid = SPECS[key].grid
    options = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    random.Random(seed).shuffle(options)
    out = []
    for params in options[:trials]:
        scores = [measure(make(key, task, classes, width, params).fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f)), task, classes)[metric] for f in range(k)]
        out.append({"params": params, "score": float(np.mean(scores))})
    sign = -1 if M.HIGHER_IS_BETTER[metric] else 1
    return sorted(out, key=lambda r: sign * r["score"])


def best_threshold(df: DataFrame, truth: str = "y", score: str = "s") -> float:
    """The score from which on to answer yes for the highest F1, over all distinct scores."""
    r = M.ranked(df, truth, score)
    return r.orderBy(F.desc(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))), F.desc("s")).first()["s"]


def _save_model(model: object, path: str) -> dict:
    """What JSON holds of a fitted model; pyspark.ml models are written to path by their own writers."""
    about: dict = {"class": f"{type(model).__module__}.{type(model).__name__}"}
    if isinstance(model, (Averaged, Stacked)):
        about |= {"classes": model.classes, "parts": [_save_model(m, f"{path}/{n}") for n, m in enumerate(model.models)]}
        if isinstance(model, Stacked):
            about["top"] = _save_model(model.top, f"{path}/top")
    elif isinstance(model, Nearest):
        about["state"] = model.save(path)
    elif isinstance(model, Capped):
        about["state"] = model.state()
    elif isinstance(model, (Baseline, Discriminant)):
        about["state"] = {k: {"array": v.tolist()} if isinstance(v, np.ndarray) else v for k, v in model.__dict__.items()}
    else:
        model.write().overwrite().save(path)
    return about


def _load_model(about: dict, path: str) -> object:
    import importlib

    module, name = about["class"].rsplit(".", 1)
    own = {c.__name__: c for c in (Averaged, Stacked, Capped, Nearest, Baseline, Discriminant)}
    if module.startswith("tabulon.") and name in own:
        if name in ("Averaged", "Stacked"):
            parts = [_load_model(a, f"{path}/{n}") for n, a in enumerate(about["parts"])]
            return Averaged(parts, about["classes"]) if name == "Averaged" else Stacked(parts, _load_model(about["top"], f"{path}/top"), about["classes"])
        if name == "Nearest":
            return Nearest.restored(about["state"], path)
        if name == "Capped":
            return Capped.restored(about["state"])
        model = own[name].__new__(own[name])
        model.__dict__ = {k: np.array(v["array"]) if isinstance(v, dict) else v for k, v in about["state"].items()}
        return model
    if module not in ("pyspark.ml.classification", "pyspark.ml.regression") or not name.endswith("Model"):
        raise ValueError(f"not a model of this library: {about['class']}")
    return getattr(importlib.import_module(module), name).load(path)


def save(trained: Trained | TrainedMany, path: str) -> None:
    """A fitted model with its encoding, labels, threshold and summary of the training data."""
    Path(path).mkdir(parents=True, exist_ok=True)
    if isinstance(trained, TrainedMany):
        for n, m in enumerate(trained.models.values()):
            save(m, f"{path}/target{n}")
        Path(path, "about.json").write_text(json.dumps({"task": trained.task, "targets": list(trained.models)}))
        return
    about = {k: v for k, v in trained.__dict__.items() if k not in ("encoding", "model")}
    about |= {"encoding": trained.encoding.__dict__, "model": _save_model(trained.model, f"{path}/model")}
    Path(path, "about.json").write_text(json.dumps(plain(about)))


def load_model(path: str) -> Trained | TrainedMany:
    about = json.loads(Path(path, "about.json").read_text())
    if "targets" in about:
        return TrainedMany(about["task"], {t: load_model(f"{path}/target{n}") for n, t in enumerate(about["targets"])})
    return Trained(**about | {"encoding": Encoding(**about["encoding"]), "model": _load_model(about["model"], f"{path}/model")})
