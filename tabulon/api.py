"""The library in one place: what a notebook imports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.values import date as text_date
from tabulon.functions.values import guess_date_format, number, resolve_all
from tabulon.operators import anomaly as _anomaly
from tabulon.operators import cluster as _cluster
from tabulon.operators import drift as _drift
from tabulon.operators import forecast as _forecast
from tabulon.operators import importance as _importance
from tabulon.operators import profile as _profile
from tabulon.operators import train as _train
from tabulon.operators.clean import Cleaned, clean, convert
from tabulon.operators.encode import Encoding, fit_auto, fit_encoding
from tabulon.operators.train import Trained, TrainedMany, load_model, train, train_many
from tabulon.sources.readers import load
from tabulon.sources.writers import fingerprint, save, write_json

__all__ = ["Cleaned", "Encoding", "Trained", "TrainedMany", "anomalies", "chosen", "clean", "compare_drift", "evaluate", "explain", "explain_text", "fingerprint", "fit_auto", "fit_encoding", "fit_forecast", "forecast", "groups", "importance", "kinds", "load", "load_forecaster", "load_model", "predict", "predict_chunks", "profile", "save", "save_forecaster", "select", "sensitivity", "session", "train", "train_many", "tune"]


def session(name: str = "tabulon") -> SparkSession:
    """A session with adaptive execution and UTC, which date functions rely on."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").getOrCreate()


def _typed(df: DataFrame, leave: tuple[str | None, ...] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with numbers and dates that are stored as text as such, and the columns of each kind."""
    found = [k for k in _profile.infer_kinds(df) if k.name not in leave]
    text = {k.name: ("numeric", "") if k.kind == "numeric" else ("datetime", k.note) for k in found if k.dtype == "string" and k.kind in ("numeric", "datetime")}
    kinds: dict[str, list[str]] = {}
    for k in found:
        kinds.setdefault(k.kind, []).append(k.name)
    return convert(df, text) if text else df, kinds


def chosen(df: DataFrame, drop: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """df without the columns to drop, or with those to keep only; names as resolve() reads them."""
    if keep:
        df = df.select(*[F.col(f"`{c}`") for c in resolve_all(list(keep), df.columns)])
    return df.drop(*resolve_all(list(drop), df.columns)) if drop else df


def kinds(df: DataFrame) -> DataFrame:
    return _profile.kinds_frame(df)


def profile(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Statistics of numeric columns, and issues."""
    typed, found = _typed(df)
    return _profile.numeric_profile(typed, found.get("numeric", [])), _profile.issues(df, target)


def predict(model: Trained, df: DataFrame) -> DataFrame:
    return model.predict(df)


def tune(df: DataFrame, target: str, row_id: str, key: str, metric: str | None = None, trials: int = 10, k: int = 3) -> list[dict]:
    """(params, score), best first, of a seeded search over a model's settings."""
    task = _train.infer_task(df, target)
    rows, classes = _train.prepare_target(df, target, task)
    encoding = fit_auto(rows.drop("label", row_id), target)
    name = _train.M.metric_name(metric or ("f1_macro" if task == _train.CLASSIFICATION else "rmse"))
    table = _train.folds(encoding.vectors(rows, [row_id, "label"]), row_id, k).persist()
    out = _train.tune(table, key, task, len(classes), len(encoding.columns()), name, trials, k)
    table.unpersist()
    return out


def predict_chunks(spark: SparkSession, model: Trained, folder: str, like: DataFrame, out: str, checkpoint: str) -> None:
    """Score the Parquet files of a folder in small batches; files that arrive later are scored by the next call."""
    from tabulon.streaming.chunks import score_stream, stream

    score_stream(stream(spark, folder, like), model.predict, out, checkpoint).awaitTermination()


def evaluate(model: Trained | TrainedMany, df: DataFrame, target: str | None = None) -> dict[str, float]:
    """All metrics of a model on labelled rows; of a model of several targets, for all of them."""
    if isinstance(model, TrainedMany):
        return model.evaluate(df)
    if model.task == _train.REGRESSION:
        x = number(F.col(target)) if dict(df.dtypes)[target] == "string" else F.col(target).cast("double")
        rows = df.withColumn("label", x).where("label is not null")
    else:
        text, _ = _train.class_text(df, target)
        rows = df.withColumn("label", (F.array_position(F.array(*[F.lit(c) for c in model.classes]), text) - 1).cast("double")).where("label >= 0")
    return _train.measure(model.scored(rows, ["label"]), model.task, len(model.classes))


def explain(model: Trained, df: DataFrame, row_id: str, rows: int = 10) -> DataFrame:
    """For the first rows by id: how the prediction changes when a column takes its typical value."""
    columns = model.encoding.inputs()
    numeric = [c for c in model.encoding.numeric if c not in model.encoding.formats]
    usual = _importance.typical(df, numeric, [c for c in columns if c not in numeric])
    some = df.orderBy(row_id).limit(rows).select(row_id, *columns)
    score = (lambda d: model.predict(d)) if model.task == _train.REGRESSION else (lambda d: model.predict(d).withColumn("predicted", F.col("confidence")))
    return _importance.explain_rows(some, columns, usual, score, row_id, "predicted")


def explain_text(model: Trained, df: DataFrame, row_id: str, rows: int = 10) -> list[str]:
    """explain() in a sentence for each row."""
    table = explain(model, df, row_id, rows).collect()
    return _importance.sentences([r.asDict() for r in table], row_id)


def sensitivity(model: Trained, df: DataFrame, row_id: str) -> dict[str, float]:
    """How much a model's answers change when a column is shuffled, without labels: most first."""
    return _importance.sensitivity(df, model.encoding.inputs(), lambda d: model.predict(d), row_id, model.task == _train.REGRESSION)


def compare_drift(reference: DataFrame, new: DataFrame, importance: dict[str, float] | None = None) -> tuple[DataFrame, str]:
    """The drift of every shared numeric and categorical column, worst first, and a verdict.

    importance: weights of columns; with them a column that matters little can't make the verdict major.
    """
    reference, found = _typed(reference)
    same = {c: ("numeric", "") for c in found.get("numeric", []) if dict(new.dtypes).get(c) == "string"}
    new = convert(new, same) if same else new
    numeric = [c for c in found.get("numeric", []) if c in new.columns]
    words = [c for c in found.get("categorical", []) if c in new.columns]
    parts = []
    if numeric:
        parts.append(_drift.numeric_drift(reference, new, numeric).select("column", "psi", "outside", "status"))
    if words:
        parts.append(_drift.category_drift(reference, new, words))
    gone = [c for c in reference.columns if c not in new.columns]
    if gone:
        parts.append(reference.sparkSession.createDataFrame([(c, None, 1.0, "missing") for c in gone], "column string, psi double, outside double, status string"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    table = _drift.ordered(table, importance)
    return table, _drift.verdict(table, importance is not None).first()["verdict"]


def date_column(df: DataFrame) -> str:
    """The one column of dates; an error if there is none or more than one."""
    found = [k.name for k in _profile.infer_kinds(df) if k.kind == "datetime"]
    if len(found) != 1:
        raise ValueError(f"name the date column: {', '.join(found)}" if found else "there is no date column")
    return found[0]


def forecast(df: DataFrame, date: str | None = None, value: str = "", group: list[str] = (), unit: str | None = None, horizon: int = 14, combine: str = "sum", inputs: list[str] = (), future: DataFrame | None = None, holidays: list[str] = (), model: str | None = None) -> DataFrame:
    """The next periods of each group; each group has the model that did best on it, or model.

    Rows after the last known value, and those of future, are plans of the inputs.
    """
    df, date = _dated(df, date)
    f = _forecast.Forecaster(date, value, list(group), unit or _forecast.frequency(df, date).first()["unit"], horizon, combine, list(inputs), model, holidays=[str(d) for d in holidays])
    return f.forecast(df, _dated(future, date)[0] if future is not None else None)


def _dated(df: DataFrame, date: str | None) -> tuple[DataFrame, str]:
    """df with its dates, which may be text, as timestamps, and their column."""
    date = date or date_column(df)
    if dict(df.dtypes)[date] == "string":
        fmt = guess_date_format(df, date)
        if not fmt:
            raise ValueError(f"{date} holds no dates of one format")
        df = df.withColumn(date, text_date(F.col(f"`{date}`"), fmt))
    return df, date


def fit_forecast(df: DataFrame, date: str | None = None, value: str = "", **options: object) -> _forecast.Forecaster:
    """One model for all groups, chosen on the largest, with a leaderboard; its forecast() goes on from any newer rows."""
    df, date = _dated(df, date)
    return _forecast.fit_forecaster(df, date, value, **options)


def save_forecaster(forecaster: _forecast.Forecaster, path: str) -> None:
    write_json(forecaster.to_dict(), path)


def load_forecaster(path: str) -> _forecast.Forecaster:
    return _forecast.Forecaster(**json.loads(Path(path).read_text()))


def groups(df: DataFrame, row_id: str, k: range = range(2, 7), algorithms: tuple[str, ...] = ("kmeans",)) -> DataFrame:
    """df with cluster, by the number of groups with the best silhouette; columns are encoded first."""
    encoding = fit_auto(df.drop(row_id))
    names = [n for n, _ in encoding.columns()]
    table = encoding.table(df, [row_id])
    vectors = encoding.vectors(df, [row_id]).join(table, row_id)
    model, _ = _cluster.choose(vectors, names, row_id, k, algorithms)
    found = _cluster.relabelled(model.transform(vectors)).select(F.col(row_id).alias("_i"), "cluster")
    return df.join(found, df[row_id] == F.col("_i"), "left").drop("_i")


def anomalies(df: DataFrame, row_id: str, share: float = 0.05, truth: str | None = None, detector: str = "ensemble") -> DataFrame:
    """df with anomaly_score, is_anomaly and reasons, from robust distance and an isolation forest.

    With truth, a 0/1 column that no detector sees, the detector with the best average precision decides; with detector
    "agreement" the one whose highest rows the mean of all shares most.
    """
    if truth:
        labels = df.select(F.col(row_id).alias("_t"), F.col(truth).cast("int").alias("_truth"))
        got = _anomalies(df.drop(truth), row_id, share, labels, detector)
        return got.join(df.select(F.col(row_id).alias("_t"), truth), got[row_id] == F.col("_t"), "left").drop("_t")
    return _anomalies(df, row_id, share, None, detector)


def _anomalies(df: DataFrame, row_id: str, share: float, truth: DataFrame | None, detector: str) -> DataFrame:
    plain = df
    df, found = _typed(df, (row_id,))
    numeric, words = found.get("numeric", []), found.get("categorical", [])
    if not numeric:
        raise ValueError("there is no numeric column")
    rows = df.withColumn("robust", _anomaly.robust_distance(numeric, _anomaly.robust_scales(df, numeric)))
    rows = _anomaly.isolation_forest(rows, numeric, row_id)
    scores = ["robust", "iforest"]
    rows = _anomaly.percentile_scores(rows, scores, row_id)
    if truth is not None or detector == "agreement":
        judged = rows if truth is None else rows.join(truth, rows[row_id] == F.col("_t"), "left").drop("_t")
        best = _anomaly.best_detectors(judged, [f"pct_{s}" for s in scores], row_id, "_truth" if truth is not None else None)
        scores = [best[0]["detector"].removeprefix("pct_")]
    rows = _anomaly.ensemble(rows, scores, share)
    rows = _anomaly.reasons(_anomaly.rarity(rows, words), numeric, words)
    out = rows.select(F.col(row_id).alias("_i"), "anomaly_score", "is_anomaly", "reasons")
    return plain.join(out, plain[row_id] == F.col("_i"), "left").drop("_i")


def importance(df: DataFrame, target: str, methods: list[str] | None = None) -> DataFrame:
    """Consensus of several methods (see operators.ranking.METHODS) on all columns: numbers, categories, dates and texts."""
    from tabulon.operators import ranking

    return _importance.consensus(ranking.scores(ranking.encoded(df, target), methods))


def select(df: DataFrame, target: str, most: int, methods: list[str] | None = None) -> list[str]:
    """The most important columns."""
    return [r["column"] for r in importance(df, target, methods).orderBy("consensus_rank").limit(most).collect()]


def columns_needed(df: DataFrame, target: str, methods: list[str] | None = None) -> tuple[list[dict], int]:
    """(points, number): cross-validated scores of the first columns by importance, and how many of them are enough."""
    from tabulon.operators import ranking

    t = ranking.encoded(df, target)
    ranked = [r["column"] for r in _importance.consensus(ranking.scores(t, methods)).orderBy("consensus_rank").collect()]
    return _importance.columns_needed(ranked, ranking.scorer(t))


def effects(model: _train.Trained, df: DataFrame, column: str) -> DataFrame:
    """(value, mean): what a model answers on average when a column takes typical values; of classes, the share of the last one."""
    said = F.col("predicted") if model.task == _train.REGRESSION else (F.col("predicted") == model.classes[-1]).cast("double")
    answer = lambda d: model.predict(d).withColumn("prediction", said.cast("double"))
    numeric = column in model.encoding.numeric and column not in model.encoding.formats
    return (_importance.effect if numeric else _importance.category_effect)(df, column, answer)
