"""Models of series that learn from all series at once and forecast them in lockstep, one step of all series after the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Penalties that ridge chooses from.
ALPHAS = tuple(10 ** (-3 + k / 2) for k in range(13))
#: Rows of a partition that models are fitted on.
ROWS = 50_000


@dataclass
class Shape:
    """What a model of a series sees: lags, trailing means, and how far back a history has to go."""

    lags: list[int]
    windows: list[int]
    season: int
    reach: int = field(init=False)

    def __post_init__(self) -> None:
        self.reach = max([*self.lags, *self.windows, self.season])

    def enough(self) -> int:
        """Periods that a series needs to be modelled."""
        return max([*self.lags, *self.windows, 0]) + 8


def calendar(ts: Column, unit: str) -> list[Column]:
    """Parts of a date as numbers that lines and trees can use: places in a cycle as 0 or 1, the year's course as a circle."""
    places = lambda c, n, first=0: [(c == first + k).cast("double") for k in range(n)]
    turn = 2 * np.pi * F.dayofyear(ts) / 365.25
    year = [F.sin(turn), F.cos(turn)]
    day = places(F.weekday(ts), 7)
    return {"hour": [*places(F.hour(ts), 24), *day], "day": [*day, *year], "week": year, "month": places(F.month(ts), 12, 1), "quarter": places(F.quarter(ts), 4, 1), "year": []}[unit]


def prepared(parts: DataFrame, keys: list[str], unit: str, inputs: list[str], horizon: int, folds: int) -> DataFrame:
    """Each series' periods with what learning and testing need.

    parts: keys, ts, y, inputs and ahead (periods to come). Adds sid (a text for the keys), i (the period's number), n
    (known periods), h (periods that a backtest forecasts), cuts (where its histories end, then n), first (the earliest
    of them), z (y less its mean, in spreads, both of the periods before first), m, s and x (calendar and inputs).
    """
    sid = F.to_json(F.struct(*keys)) if keys else F.lit("")
    own = Window.partitionBy("sid")
    rows = parts.withColumn("sid", sid).withColumn("i", F.row_number().over(own.orderBy("ts")) - 1)
    rows = rows.withColumn("n", F.count(F.when(~F.col("ahead"), 1)).over(own))
    h = F.least(F.lit(horizon), F.greatest(F.lit(1), F.floor(F.col("n") / 4))).cast("int")
    rows = rows.withColumn("h", h)
    tested = F.filter(F.transform(F.sequence(F.lit(folds), F.lit(1)), lambda k: (F.col("n") - F.col("h") * k).cast("int")), lambda c: c >= 8) if folds else F.array().cast("array<int>")
    rows = rows.withColumn("tested", tested).withColumn("first", F.coalesce(F.get("tested", F.lit(0)), F.col("n").cast("int")))
    rows = rows.withColumn("cuts", F.concat("tested", F.array(F.col("n").cast("int"))))
    before = F.when(F.col("i") < F.col("first"), F.col("y"))
    rows = rows.withColumns({"m": F.avg(before).over(own), "s": F.stddev_pop(before).over(own)})
    rows = rows.withColumn("s", F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0)).withColumn("z", (F.col("y") - F.col("m")) / F.col("s"))
    x = [c.cast("double") for c in (*calendar(F.col("ts"), unit), *(F.col(c) for c in inputs))]
    return rows.withColumn("x", F.array(*x) if x else F.array().cast("array<double>"))


def learning(rows: DataFrame, shape: Shape) -> DataFrame:
    """sid, i, first, n, features (as an array), level (z) and change (from the period before) of periods with a whole past."""
    w = Window.partitionBy("sid").orderBy("i")
    lags = [F.lag("z", k).over(w) for k in shape.lags]
    means = [F.avg("z").over(w.rowsBetween(-n, -1)) for n in shape.windows]
    past = max([*shape.lags, *shape.windows, 1])
    seen = rows.where(~F.col("ahead")).select("sid", "i", "first", "n", "z", F.lag("z", 1).over(w).alias("last"), F.concat(F.array(*lags, *means, F.col("i").cast("double")), "x").alias("f"))
    return seen.where(F.col("i") >= past).select("sid", "i", "first", "n", "f", F.col("z").alias("level"), (F.col("z") - F.col("last")).alias("change"))


def states(rows: DataFrame, keys: list[str], shape: Shape, horizon: int) -> DataFrame:
    """A row for each series and cut: hist (its last z before the cut), xs, ts and actual of the periods from there on."""
    cut = F.explode(F.filter("cuts", lambda c: (F.col("i") >= c - shape.reach) & (F.col("i") < c + horizon))).alias("cut")
    near = rows.select("sid", *keys, "n", "h", "m", "s", "i", "z", "y", "x", "ts", cut)
    past, to_come = F.col("i") < F.col("cut"), F.col("i") >= F.col("cut")
    listed = lambda cond, *c: F.sort_array(F.collect_list(F.when(cond, F.struct("i", *c))))
    out = near.groupBy("sid", "cut").agg(*[F.first(k).alias(k) for k in keys], *[F.first(c).alias(c) for c in ("n", "h", "m", "s")], listed(past, "z").alias("p"), listed(to_come, "x", "ts", "y").alias("q"))
    return out.select("sid", "cut", *keys, "n", "h", "m", "s", F.col("p")["z"].alias("hist"), F.col("q")["x"].alias("xs"), F.col("q")["ts"].alias("dates"), F.col("q")["y"].alias("actual"))


def nodes_of(model: object) -> list[tuple[float, np.ndarray]]:
    """(weight, nodes) of each tree of a pyspark.ml ensemble; a node is (column, cut, left, right, value), column -1 for a leaf."""
    out: list[list[tuple]] = []
    lines = iter(model.toDebugString.splitlines()[1:])

    def read(nodes: list[tuple], line: str) -> int:
        at = len(nodes)
        nodes.append(())
        if line.startswith("Predict:"):
            nodes[at] = (-1, 0.0, at, at, float(line.split(":")[1]))
            return at
        column, cut = line.removeprefix("If (feature ").removesuffix(")").split(" <= ")
        left = read(nodes, next(lines).strip())
        next(lines)  # Else
        nodes[at] = (int(column), float(cut), left, read(nodes, next(lines).strip()), 0.0)
        return at

    for line in lines:
        if line.strip().startswith("Tree "):
            out.append([])
            read(out[-1], next(lines).strip())
    weights = list(model.treeWeights)
    total = sum(weights) if isinstance(model, R.RandomForestRegressionModel) else 1.0
    return [(w / total, np.array(t)) for w, t in zip(weights, out, strict=True)]


def _answers(trees: list[tuple[float, np.ndarray]], f: np.ndarray) -> np.ndarray:
    total, every = np.zeros(len(f)), np.arange(len(f))
    for weight, t in trees:
        column, cut, left, right = t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int)
        at = np.zeros(len(f), int)
        while (column[at] >= 0).any():
            at = np.where(column[at] < 0, at, np.where(f[every, np.maximum(column[at], 0)] <= cut[at], left[at], right[at]))
        total += weight * t[at, 4]
    return total


def roll(state: DataFrame, shape: Shape, horizon: int, trees: list[tuple[float, np.ndarray]] | None = None) -> DataFrame:
    """sid, cut and path: the next horizon values of z, each predicted from those before, for all series of a batch at once.

    trees: of the change from the period before; or None for lines (columns w and b), of the level. A history that is
    shorter than a lag begins with its first value.
    """
    lags, windows, reach = shape.lags, shape.windows, shape.reach
    wide = trees is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            hist = np.array([np.concatenate([np.full(max(0, reach - len(v)), v[0]), v[-reach:]]) for v in part["hist"]], float)
            xs = np.array([np.concatenate([np.asarray(x, float) for x in v[:horizon]]) for v in part["xs"]], float).reshape(len(part), horizon, -1)
            w, b = (np.array(part["w"].tolist(), float), part["b"].to_numpy(float)) if wide else (None, None)
            path = np.concatenate([hist, np.zeros((len(part), horizon))], 1)
            for k in range(horizon):
                now = reach + k
                f = np.column_stack([*(path[:, now - j] for j in lags), *(path[:, now - v : now].mean(1) for v in windows), part["cut"].to_numpy(float) + k, xs[:, k]])
                path[:, now] = (f * w).sum(1) + b if wide else path[:, now - 1] + _answers(trees, f)
            yield pd.DataFrame({"sid": part["sid"], "cut": part["cut"], "path": list(path[:, reach:])})

    return state.select("sid", "cut", "hist", "xs", *(["w", "b"] if wide else [])).mapInPandas(run, "sid string, cut int, path array<double>")


def ridge(x: np.ndarray, y: np.ndarray, alphas: tuple[float, ...] = ALPHAS) -> tuple[np.ndarray, float]:
    """Weights and intercept; the penalty is the one with the least leave-one-out error."""
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-12] = 1
    z, m = (x - mean) / std, y.mean()
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    uy, best = u.T @ (y - m), None
    for a in alphas:
        d = s**2 / (s**2 + a)
        left = (y - m - u @ (d * uy)) / np.maximum(1 - (u**2) @ d - 1 / len(y), 1e-9)
        loss = float((left**2).mean())
        if best is None or loss < best[0]:
            best = (loss, vt.T @ (s / (s**2 + a) * uy) / std)
    return best[1], float(m - mean @ best[1])


def lines(rows: DataFrame) -> DataFrame:
    """sid, w, b: a ridge line for each series, fitted to its own periods (of which it has a bounded number)."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        w, b = ridge(np.array(part["f"].tolist(), float), part["level"].to_numpy(float))
        return pd.DataFrame({"sid": [part["sid"].iloc[0]], "w": [w], "b": [b]})

    return rows.groupBy("sid").applyInPandas(fit, "sid string, w array<double>, b double")


def grown(rows: DataFrame, name: str, seed: int = 42) -> list[tuple[float, np.ndarray]] | None:
    """Boosted trees or a forest of pyspark.ml, fitted once over the periods of all series."""
    table = rows.select(array_to_vector("f").alias("features"), F.col("change").alias("label"))
    n = rows.count()
    if not n:
        return None
    table = table.repartition(max(1, -(-n // ROWS))).cache()
    if name == "forest":
        made = R.RandomForestRegressor(numTrees=20, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="onethird", seed=seed)
    else:
        made = R.GBTRegressor(maxIter=20, maxDepth=4, stepSize=0.25, minInstancesPerNode=5, seed=seed)
    fitted = made.fit(table)
    table.unpersist()
    return nodes_of(fitted)


def paths(name: str, state: DataFrame, known: DataFrame, shape: Shape, horizon: int) -> DataFrame:
    """sid, cut and path (z of the next horizon periods) by a model: of all states, or of those that it can forecast.

    known: periods that may be learned from. States with too short a history for a learned model hold their last value.
    """
    last = F.element_at("hist", -1)
    if name == "last value":
        return state.select("sid", "cut", F.array_repeat(last, horizon).alias("path"))
    if name == "last season":
        place = lambda k: F.element_at("hist", (k % shape.season).cast("int") - shape.season)
        held = F.when(F.size("hist") >= shape.season, F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), place)).otherwise(F.array_repeat(last, horizon))
        return state.select("sid", "cut", held.alias("path"))
    able = (F.col("cut") >= shape.enough()) if shape.lags else F.lit(False)
    short = state.where(~able).select("sid", "cut", F.array_repeat(last, horizon).alias("path"))
    long = state.where(able)
    if name == "ridge":
        out = roll(long.join(lines(known), "sid"), shape, horizon)
    else:
        trees = grown(known, name)
        if trees is None:
            return short
        out = roll(long, shape, horizon, trees)
    return out.unionByName(short)
