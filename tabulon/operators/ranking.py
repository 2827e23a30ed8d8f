"""Importance of a table's columns by many methods: numbers, categories, dates and texts are seen as encoded, and summed back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import importance as I
from tabulon.operators.encode import Encoding, fit_auto
from tabulon.operators.train import CLASSIFICATION, infer_task, prepare_target
from tabulon.sources.scratch import stored

#: What importance() asks unless told otherwise, by whether the target has classes.
DEFAULT = {True: ("f", "mi", "chi2", "variance"), False: ("f", "rank", "variance")}
#: The least weight that counts as kept.
KEPT = 1e-6


@dataclass
class Encoded:
    """A table with label, fold and encoded columns e0, e1, …; origin says which column each comes from, two which are 0 or 1."""

    rows: DataFrame
    raw: DataFrame
    origin: dict[str, str]
    classes: int
    two: list[str]

    @property
    def names(self) -> list[str]:
        return list(self.origin)

    def of(self, columns: list[str]) -> list[str]:
        return [e for e, c in self.origin.items() if c in columns]

    def columns(self) -> list[str]:
        return list(dict.fromkeys(self.origin.values()))


def encoded(df: DataFrame, target: str, encoding: Encoding | None = None, folds: int = 3) -> Encoded:
    """df with its columns encoded as models see them; encoded columns of one value are left out."""
    task = infer_task(df, target)
    rows, classes = prepare_target(df, target, task)
    known = encoding or fit_auto(rows.drop("label"), target)
    pairs = known.columns()
    table = known.table(rows.withColumn("__fold", F.pmod(F.xxhash64(*rows.columns), F.lit(folds)).cast("int")), ["label", "__fold"])
    table = table.toDF("label", "fold", *[f"e{k}" for k in range(len(pairs))])
    table = stored(table, "encoded")
    seen = table.agg(*[(F.min(f"e{k}") < F.max(f"e{k}")).alias(f"e{k}") for k in range(len(pairs))]).first() if pairs else {}
    origin = {f"e{k}": c for k, (_, c) in enumerate(pairs) if seen[f"e{k}"]}
    if not origin:
        raise ValueError("there is no column that varies")
    two = [f"e{k}" for k, (name, c) in enumerate(pairs) if c in known.categories or name == f"{c}__missing"]
    return Encoded(table, rows, origin, len(classes) if task == CLASSIFICATION else 0, two)


def scorer(t: Encoded, folds: int = 3) -> Callable[[list[str]], list[float]]:
    """For a set of columns, the score of a linear model in each fold: R2, or accuracy."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.regression import LinearRegression

    made = LogisticRegression(regParam=1e-4, maxIter=25) if t.classes else LinearRegression(regParam=1e-6)
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if t.classes else RegressionEvaluator(metricName="r2")

    def score(columns: list[str]) -> list[float]:
        rows = I._vector(t.rows, t.of(columns)).select("label", "features", "fold").persist()
        out = [judge.evaluate(made.fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f))) for f in range(folds)]
        rows.unpersist()
        return out

    return score


def _mean(t: Encoded) -> Callable[[list[str]], float]:
    score = scorer(t)
    return lambda columns: sum(s := score(columns)) / len(s)


def _summed(t: Encoded, found: dict[str, float]) -> DataFrame:
    return I.back_to_columns(t.rows.sparkSession.createDataFrame([(c, float(v)) for c, v in found.items()], "column string, score double"), t.origin)


def _plain(t: Encoded, found: dict[str, float]) -> DataFrame:
    return t.rows.sparkSession.createDataFrame([(c, float(v)) for c, v in found.items()], "column string, score double")


def _variance(t: Encoded) -> DataFrame:
    """Numbers by their spread, other columns by the share of all but their most frequent value."""
    from tabulon.operators.profile import NUMERIC

    kinds = dict(t.raw.dtypes)
    numbers = [c for c in t.columns() if kinds[c] in NUMERIC or kinds[c].startswith("decimal")]
    others = [c for c in t.columns() if c not in numbers]
    parts = ([I.variance(t.raw, numbers)] if numbers else []) + ([I.spread_of_categories(t.raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in others]), others)] if others else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _permuted(t: Encoded) -> DataFrame:
    """How much worse a forest answers when all that comes from a column is moved to other rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor

    model = (RandomForestClassifier if t.classes else RandomForestRegressor)(numTrees=20, maxDepth=8, seed=42).fit(I._vector(t.rows.where("fold > 0"), t.names).select("label", "features"))
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if t.classes else RegressionEvaluator(metricName="r2")
    held = t.rows.where("fold = 0")
    measure = lambda df: judge.evaluate(model.transform(I._vector(df, t.names).select("label", "features")))
    base, out = measure(held), {}
    for c in t.columns():
        own = t.of([c])
        mixed = I.shuffled(held, own)
        out[c] = base - measure(mixed.withColumns({e: F.col(f"shuffled_{e}") for e in own}))
    return _plain(t, out)


def _stepwise(t: Encoded, direction: str) -> DataFrame:
    """The earlier a column is chosen, or the later it goes, the more it scores: 1 for the first one chosen or the last one left."""
    columns = t.columns()
    path = I.search(columns, _mean(t), direction)
    if direction == "forward":
        order = [next(c for c in now if c not in before) for before, now in zip([[], *[s for s, _ in path]], [s for s, _ in path], strict=False)]
    else:
        sets = [columns, *[s for s, _ in path]]
        gone = [next(c for c in before if c not in now) for before, now in zip(sets, sets[1:], strict=False)]
        order = [*[c for c in columns if c not in gone], *gone[::-1]]
    return _plain(t, {c: 1 - k / len(columns) for k, c in enumerate(order)})


#: Each method gives (column, score) of the table's own columns.
METHODS: dict[str, Callable[[Encoded], DataFrame]] = {
    "f": lambda t: I.back_to_columns(I.f_test(t.rows, t.names, "label") if t.classes else I.f_regression(t.rows, t.names, "label"), t.origin),
    "mi": lambda t: I.back_to_columns(I.mutual_information(t.rows, t.names, "label"), t.origin),
    "chi2": lambda t: I.back_to_columns(I.chi_square(t.rows, t.names, "label"), t.origin),
    "rank": lambda t: I.back_to_columns((I.rank_correlation_of_classes if t.classes else I.rank_correlation)(t.rows, t.names, "label", t.two), t.origin),
    "variance": _variance,
    "forest": lambda t: _summed(t, I.forest(t.rows, t.names, "label", bool(t.classes))),
    "extratrees": lambda t: _summed(t, I.tree_weights(t.rows, t.names, "label", bool(t.classes), "extra")),
    "boosting": lambda t: _summed(t, I.tree_weights(t.rows, t.names, "label", bool(t.classes))),
    "l1": lambda t: _summed(t, I.weights(t.rows, t.names, "label", bool(t.classes), 0.02)),
    "linear": lambda t: _summed(t, I.weights(t.rows, t.names, "label", bool(t.classes))),
    "permutation": _permuted,
    "drop": lambda t: _plain(t, I.drop_column(t.columns(), _mean(t))),
    "rfe": lambda t: _summed(t, I.eliminated(t.names, lambda left: I.weights(t.rows, left, "label", bool(t.classes)))),
    "forward": lambda t: _stepwise(t, "forward"),
    "backward": lambda t: _stepwise(t, "backward"),
    "exhaustive": lambda t: _plain(t, I.best_subsets(I.search(t.columns(), _mean(t), "exhaustive"), t.columns())),
    "stability": lambda t: _summed(t, I.stability(t.rows.withColumn("__id", F.xxhash64("fold", "label", *t.names)), t.names, "label", "__id", bool(t.classes), rounds=10)),
    "boruta": lambda t: _summed(t, {c: float(v) for c, v in I.boruta(t.rows, t.names, "label", bool(t.classes), rounds=8).items()}),
}
#: Those that need classes.
CLASSES_ONLY = ("mi", "chi2")


def scores(t: Encoded, methods: list[str] | None = None) -> DataFrame:
    """(method, column, score) of each method; the mutual information and chi-square of a numeric target aren't offered."""
    chosen = list(methods or DEFAULT[bool(t.classes)])
    unknown = [m for m in chosen if m not in METHODS]
    if unknown:
        raise ValueError(f"no method {', '.join(unknown)}; there are {', '.join(METHODS)}")
    if not t.classes and (wrong := [m for m in chosen if m in CLASSES_ONLY]):
        raise ValueError(f"{', '.join(wrong)}: the target has no classes")
    out = None
    for m in chosen:
        part = METHODS[m](t).select(F.lit(m).alias("method"), "column", F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
