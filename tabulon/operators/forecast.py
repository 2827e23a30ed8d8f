"""Forecasting: regular series, features of the past, backtests and recursive forecasts of all series in lockstep."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import lockstep
from tabulon.sources.scratch import stored

#: Unit of a series: days a period, season in periods, interval text.
UNITS = {"hour": (1 / 24, 24, "INTERVAL 1 HOUR"), "day": (1.0, 7, "INTERVAL 1 DAY"), "week": (7.0, 52, "INTERVAL 7 DAYS"), "month": (30.44, 12, "INTERVAL 1 MONTH"), "quarter": (91.3, 4, "INTERVAL 3 MONTHS"), "year": (365.25, 1, "INTERVAL 1 YEAR")}
Z80 = 1.2816
MAX_PERIODS = 10_000
HOLIDAY_INPUTS = ("is_holiday", "day_before", "day_after")
#: Models that are compared, the simplest first.
MODELS = ("last value", "last season", "ridge", "boosting", "forest")


def frequency(df: DataFrame, ts: str) -> DataFrame:
    """One row: the median gap between distinct dates in days, and the unit nearest to it in proportion.

    Gaps are taken within ranges of dates and across their ends, so that no window holds all dates.
    """
    days = df.select((F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000).alias("d")).where("d is not null").distinct()
    month = F.floor(F.col("d") / 256)
    w = Window.partitionBy("m").orderBy("d")
    inner = days.withColumn("m", month).withColumn("gap", F.col("d") - F.lag("d").over(w))
    ends = inner.groupBy("m").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    across = ends.select((F.col("low") - F.lag("high").over(Window.orderBy("m"))).alias("gap"))
    gap = inner.select("gap").unionByName(across).where("gap is not null").agg(F.percentile("gap", 0.5).alias("days"))
    far = {u: F.abs(F.ln(F.col("days") / d)) for u, (d, _, _) in UNITS.items()}
    best = F.least(*far.values())
    unit = F.coalesce(*[F.when(v == best, F.lit(u)) for u, v in far.items()])
    return gap.select("days", unit.alias("unit"))


def period(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys, of which null is one like others."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left").drop(*[f"__{k}" for k in keys])


def series(df: DataFrame, ts: str, y: str, group: list[str] = (), unit: str = "day", combine: str = "sum", inputs: list[str] = ()) -> DataFrame:
    """One row for each group and period from its first to its last: ts, y and inputs; missing periods are interpolated.

    Values of one period are summed, averaged or the last of them taken. Gaps of y are filled linearly, flat at the ends;
    inputs keep their last known value, 0 before it. Rows after the last known y are plans, and left out here.
    """
    group = list(group)
    how = {"sum": F.sum, "mean": F.avg}.get(combine)
    value = how(F.col(y).cast("double")) if how else F.max_by(F.col(y).cast("double"), F.struct(ts, y))
    per = df.where(F.col(ts).isNotNull()).groupBy(*group, period(F.col(ts), unit).alias("ts")).agg(value.alias("y"), *[F.avg(F.col(c).cast("double")).alias(c) for c in inputs])
    known = per.where("y is not null").groupBy(*group).agg(F.min("ts").alias("_low"), F.max("ts").alias("_high"))
    spine = known.select(*group, F.explode(F.sequence("_low", "_high", F.expr(UNITS[unit][2]))).alias("ts"))
    out = _matched(spine, per, [*group, "ts"])
    w = Window.partitionBy(*group).orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("t", F.row_number().over(w) - 1)
    at = F.when(F.col("y").isNotNull(), F.col("t"))
    y0, t0 = F.last("y", True).over(back), F.last(at, True).over(back)
    y1, t1 = F.first("y", True).over(ahead), F.first(at, True).over(ahead)
    filled = F.when(F.col("y").isNotNull(), F.col("y")).when(y0.isNull(), y1).when(y1.isNull(), y0).otherwise(y0 + (y1 - y0) * (F.col("t") - t0) / (t1 - t0))
    held = [F.coalesce(F.last(c, True).over(back), F.lit(0.0)).alias(c) for c in inputs]
    return out.select(*group, "ts", "t", filled.alias("y"), F.col("y").isNull().alias("filled"), *held)


def newest(df: DataFrame, group: list[str], periods: int = MAX_PERIODS) -> DataFrame:
    """The last periods of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc("ts"))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= periods).drop("_k")


def plans(df: DataFrame, ts: str, y: str, group: list[str] = ()) -> DataFrame:
    """Rows after the last known y of their group."""
    last = df.where(F.col(y).isNotNull()).groupBy(*group).agg(F.max(ts).alias("_last"))
    joined = _matched(df, last, list(group)) if group else df.crossJoin(F.broadcast(last))
    return joined.where(F.col(ts) > F.col("_last")).drop("_last")


def periods_between(first: Column, last: Column, unit: str) -> Column:
    """How many periods lie between two dates of a calendar; 0 if they are in one, negative if last is earlier."""
    low, high = period(first, unit), period(last, unit)
    step = F.expr(UNITS[unit][2])
    return F.when(low <= high, F.size(F.sequence(low, high, step)) - 1).otherwise(1 - F.size(F.sequence(high, low, step)))


def planned(history: DataFrame, group: list[str], unit: str, horizon: int, inputs: list[str], future: DataFrame | None = None) -> DataFrame:
    """(group, ts, inputs) of the next horizon periods of each group: planned values, else the last one known, else 0.

    history: as series() returns it. future: group, ts and some of the inputs, at any times; those of one period are averaged.
    """
    keys = list(group)
    last = history.groupBy(*keys).agg(F.max("ts").alias("_last"), *[F.max_by(c, "ts").alias(f"_{c}") for c in inputs])
    step = F.expr(UNITS[unit][2])
    ahead = last.withColumn("ts", F.explode(F.slice(F.sequence("_last", F.col("_last") + step * horizon, step), 2, horizon)))
    have = [c for c in inputs if future is not None and c in future.columns]
    if have:
        per = future.groupBy(*keys, period(F.col("ts"), unit).alias("ts")).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in have])
        ahead = _matched(ahead, per, [*keys, "ts"])
        w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        ahead = ahead.withColumns({c: F.last(c, True).over(w) for c in have})
    out = [F.coalesce(*([F.col(c)] if c in have else []), F.col(f"_{c}"), F.lit(0.0)).cast("double").alias(c) for c in inputs]
    return ahead.select(*keys, "ts", *out)


def totals(df: DataFrame, ts: str = "ts", values: tuple[str, ...] = ("forecast",)) -> DataFrame:
    """Sums over all groups at each date; null only where all are null."""
    return df.groupBy(ts).agg(*[F.sum(c).alias(c) for c in values])


@dataclass
class Recipe:
    """Lags and trailing means that a model of a series gets."""

    lags: list[int]
    windows: list[int]
    season: int


def recipe(unit: str, periods: int) -> Recipe:
    season = UNITS[unit][1]
    third = max(1, periods // 3)
    lags = sorted({1, 2, 3, season, 2 * season, *([168] if unit == "hour" else [])})
    return Recipe([k for k in lags if k <= third], [w for w in sorted({3, season}) if 1 < w <= third], season)


def features(df: DataFrame, group: list[str], unit: str, r: Recipe, inputs: list[str] = ()) -> DataFrame:
    """group, ts, t, y, diff (from the period before), lag_k, mean_w of the w before, calendar parts and inputs."""
    from tabulon.functions.values import calendar_parts

    w = Window.partitionBy(*group).orderBy("ts")
    lags = [F.lag("y", k).over(w).alias(f"lag_{k}") for k in r.lags]
    means = []
    for n in r.windows:
        before = w.rowsBetween(-n, -1)
        means.append(F.when(F.count("y").over(before) == n, F.avg("y").over(before)).alias(f"mean_{n}"))
    return df.select(*group, "ts", "t", "y", (F.col("y") - F.lag("y", 1).over(w)).alias("diff"), *lags, *means, *calendar_parts(F.col("ts"), unit), *inputs)


def naive(df: DataFrame, group: list[str], horizon: int, season: int) -> DataFrame:
    """(group, fold 0 rows' step, actual, naive, seasonal): forecasts of the last horizon periods from those before."""
    w = Window.partitionBy(*group).orderBy(F.desc("ts"))
    ranked = df.withColumn("back", F.row_number().over(w))
    last = ranked.where(F.col("back") == horizon + 1).select(*group, F.col("y").alias("naive"))
    test = ranked.where(F.col("back") <= horizon).withColumn("step", horizon + 1 - F.col("back"))
    # the same place of the last full season before the cut
    source = ranked.where((F.col("back") > horizon) & (F.col("back") <= horizon + season)).select(*group, (season - (F.col("back") - horizon)).alias("_place"), F.col("y").alias("seasonal"))
    test = test.withColumn("_place", (F.col("step") - 1) % season)
    key = list(group)
    out = test.join(last, key) if key else test.crossJoin(F.broadcast(last))
    return out.join(source, [*key, "_place"], "left").select(*key, "ts", "step", F.col("y").alias("actual"), "naive", "seasonal")


def errors(df: DataFrame, actual: str, predicted: str, baseline: str | None = None, group: list[str] = ()) -> DataFrame:
    """mae, rmse, bias, mape (of actuals other than 0) and, with a baseline, its mae and the ratio to it."""
    a, p = F.col(actual), F.col(predicted)
    out = [F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) ** 2)).alias("rmse"), F.avg(p - a).alias("bias"), F.avg(F.abs((a - p) / F.nullif(a, F.lit(0.0)))).alias("mape")]
    if baseline:
        base = F.avg(F.abs(a - F.col(baseline)))
        out += [base.alias("baseline_mae"), (F.avg(F.abs(a - p)) / F.nullif(base, F.lit(0.0))).alias("vs_baseline")]
    return df.groupBy(*group).agg(*out) if group else df.agg(*out)


def step_spread(df: DataFrame, step: str, error: str, reach: int = 2) -> DataFrame:
    """(step, rmse, width): squared errors pooled over neighbouring steps, never narrower than an earlier step."""
    per = df.groupBy(F.col(step).alias("step")).agg(F.sum(F.col(error) ** 2).alias("s"), F.count("*").alias("n"))
    w = Window.orderBy("step").rangeBetween(-reach, reach)
    pooled = per.select("step", F.sqrt(F.sum("s").over(w) / F.sum("n").over(w)).alias("rmse"))
    return pooled.select("step", "rmse", (Z80 * F.max("rmse").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).alias("width"))


def profile(df: DataFrame, unit: str = "day", group: list[str] = ()) -> DataFrame:
    """(group, place, mean, relative): the mean at each weekday, hour, month or quarter over the overall mean."""
    place = {"hour": F.hour("ts"), "day": F.weekday("ts"), "week": F.month("ts"), "month": F.month("ts"), "quarter": F.quarter("ts")}[unit]
    means = df.groupBy(*group, place.alias("place")).agg(F.avg("y").alias("mean"))
    whole = df.groupBy(*group).agg(F.avg("y").alias("_all"))
    joined = means.join(whole, list(group)) if group else means.crossJoin(F.broadcast(whole))
    return joined.select(*group, "place", "mean", (F.col("mean") / F.col("_all")).alias("relative"))


def trend(df: DataFrame, group: list[str] = ()) -> DataFrame:
    """(group, slope, mean, change): the least-squares slope a period, and what it adds up to in relation to the mean."""
    return df.groupBy(*group).agg(F.regr_slope("y", "t").alias("slope"), F.avg("y").alias("mean"), (F.regr_slope("y", "t") * (F.max("t") - F.min("t")) / F.nullif(F.abs(F.avg("y")), F.lit(0.0))).alias("change"))


def input_effects(df: DataFrame, inputs: list[str], group: list[str] = ()) -> DataFrame:
    """(group, input, lift, corr): for 0/1 inputs how much higher y is with them; for all, the correlation."""
    out = []
    for c in inputs:
        x = F.col(c)
        on, off = F.avg(F.when(x == 1, F.col("y"))), F.avg(F.when(x == 0, F.col("y")))
        out.append(F.struct(F.lit(c).alias("input"), F.when(F.bool_and(x.isin(0, 1)), on / F.nullif(off, F.lit(0.0)) - 1).alias("lift"), F.corr(x, "y").alias("corr")))
    return df.groupBy(*group).agg(F.array(*out).alias("x")).select(*group, F.explode("x").alias("x")).select(*group, "x.*")


def holidays(df: DataFrame, dates: DataFrame) -> DataFrame:
    """df with is_holiday, day_before and day_after; dates: a column day of holidays, far fewer than rows."""
    days = F.broadcast(dates.select(F.col("day").cast("date").alias("_d")).distinct())
    flagged = days.select(F.explode(F.array(*[F.struct(F.date_add("_d", k).alias("_day"), F.lit(-k).alias("_o")) for k in (-1, 0, 1)])).alias("x")).select("x.*").groupBy("_day").agg(*[F.max((F.col("_o") == o).cast("int")).alias(n) for n, o in (("is_holiday", 0), ("day_before", 1), ("day_after", -1))])
    out = df.join(F.broadcast(flagged), F.col("ts").cast("date") == F.col("_day"), "left").drop("_day")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("is_holiday", "day_before", "day_after")})


def holidays_within(df: DataFrame, dates: DataFrame, span: int) -> DataFrame:
    """df with holidays: how many of the days lie in the span days that end at ts. Each day is listed for the periods' ends that it can meet."""
    days = dates.select(F.explode(F.sequence(F.col("day").cast("date"), F.date_add(F.col("day").cast("date"), span - 1))).alias("_end")).groupBy("_end").agg(F.count("*").alias("holidays"))
    out = df.join(F.broadcast(days), F.col("ts").cast("date") == F.col("_end"), "left").drop("_end")
    return out.withColumn("holidays", F.coalesce("holidays", F.lit(0)))


# --- models


def _parts(df: DataFrame, group: list[str], inputs: list[str], future: DataFrame | None, unit: str, horizon: int) -> DataFrame:
    """The newest periods of each group and, marked, the inputs of those to come."""
    known = newest(df, group).select(*group, "ts", "y", *[F.col(c).cast("double").alias(c) for c in inputs], F.lit(False).alias("ahead"))
    ahead = planned(df, group, unit, horizon, inputs, future)
    return known.unionByName(ahead.select(*group, "ts", F.lit(None).cast("double").alias("y"), *inputs, F.lit(True).alias("ahead")))


@dataclass
class _Told:
    """Series made ready for models, and what the models of a backtest say of them."""

    rows: DataFrame
    state: DataFrame
    shape: lockstep.Shape
    learned: DataFrame
    names: list[str]


def _ready(df: DataFrame, keys: list[str], unit: str, horizon: int, folds: int, inputs: list[str], future: DataFrame | None) -> _Told:
    rows = stored(lockstep.prepared(_parts(df, keys, inputs, future, unit, horizon), keys, unit, inputs, horizon, folds), "series")
    longest = rows.agg(F.max("n")).first()[0] or 0
    r = recipe(unit, longest)
    shape = lockstep.Shape(r.lags, r.windows, r.season)
    names = [f"key_{k}" for k in range(len(keys))]
    state = stored(lockstep.states(rows.withColumnsRenamed(dict(zip(keys, names, strict=True))), names, shape, horizon), "states")
    return _Told(rows, state, shape, lockstep.learning(rows, shape), names)


def _tests(told: _Told, keys: list[str], horizon: int, models: list[str]) -> DataFrame:
    """(sid, group, model, order, fold, step, actual, predicted, naive) of backtests; order is the model's place in MODELS.

    Each model is fitted once, to what comes before the first of a series' cuts; every cut has its own history.
    """
    state = told.state.where(F.col("cut") < F.col("n"))
    known = told.learned.where(F.col("i") < F.col("first"))
    out = None
    for m in models:
        path = lockstep.paths(m, state, known, told.shape, horizon)
        path = path.select("sid", "cut", "path", F.lit(m).alias("model"), F.lit(MODELS.index(m)).alias("order"))
        out = path if out is None else out.unionByName(path)
    each = state.join(out, ["sid", "cut"]).select("*", F.posexplode("path").alias("k", "z")).where(F.col("k") < F.col("h"))
    back = lambda z: F.col("m") + F.col("s") * z
    fold = ((F.col("n") - F.col("cut")) / F.col("h") - 1).cast("int")
    shown = [F.col(n).alias(k) for n, k in zip(told.names, keys, strict=True)]
    return each.select(F.col("sid").alias("_sid"), *shown, "model", F.col("order").alias("_order"), fold.alias("fold"), (F.col("k") + 1).alias("step"), F.get("actual", "k").alias("actual"), back(F.col("z")).alias("predicted"), back(F.element_at("hist", -1)).alias("naive"))


def backtest(df: DataFrame, group: list[str], unit: str, horizon: int, folds: int = 3, inputs: list[str] = (), models: tuple[str, ...] = MODELS) -> DataFrame:
    """(group, model, fold, step, actual, predicted, naive): forecasts of the last periods from those before, fold 0 the newest.

    df: as series() returns it. naive is the last value before the cut. Models are fitted to what comes before the first cut.
    """
    told = _ready(df, list(group), unit, horizon, folds, list(inputs), None)
    return _tests(told, list(group), horizon, list(models)).drop("_sid", "_order")


def leaderboard(tests: DataFrame, group: list[str] = ()) -> DataFrame:
    """(model, mae, rmse, bias, relative, n_groups), the best first, of backtests: relative is the mean over groups of a
    model's mean absolute error over that of the last value, so that large groups don't decide alone.
    """
    e = F.col("predicted") - F.col("actual")
    per = tests.groupBy(*group, "model").agg(F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(F.col("naive") - F.col("actual"))).alias("base"), F.sum(e * e).alias("s"), F.sum(e).alias("b"), F.count("*").alias("n"))
    out = per.groupBy("model").agg(F.avg("mae").alias("mae"), F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"), (F.sum("b") / F.sum("n")).alias("bias"), F.avg(F.col("mae") / F.greatest("base", F.lit(1e-12))).alias("relative"), F.count("*").alias("n_groups"))
    return out.orderBy("relative", "model")


def choose(df: DataFrame, group: list[str], unit: str, horizon: int, folds: int = 3, inputs: list[str] = (), models: tuple[str, ...] = MODELS) -> tuple[str, list[dict]]:
    """(model, leaderboard): the model with the least relative error over all groups.

    Groups too short for a backtest have no say; without any, the last value is chosen.
    """
    keys = list(group)
    board = [r.asDict() for r in leaderboard(backtest(df, keys, unit, horizon, folds, inputs, models), keys).collect()]
    return (board[0]["model"] if board else "last value"), board


def forecast(df: DataFrame, group: list[str], unit: str, horizon: int, folds: int = 3, inputs: list[str] = (), future: DataFrame | None = None, model: str | None = None, models: tuple[str, ...] = MODELS) -> DataFrame:
    """(group, model, ts, step, forecast, low, high, backtest_mae) of the next horizon periods of every group.

    df: as series() returns it, with inputs; future: planned values of inputs, as planned() takes them. Models (last value,
    last season, ridge, boosted trees and a forest on lags, trailing means, trend, calendar and inputs) are backtested on
    folds cuts; the one with the least mean absolute error of a group, or model if given, forecasts it, with an 80% band
    from its own step errors, which past the backtested steps grows with the root of the step. Ridge is a line for each
    series, trees of pyspark.ml learn from all series together, each in its own mean and spread, and series are forecast in
    lockstep: a row is a series, and a batch of them takes one step after the other. A series counts with its newest MAX_PERIODS periods.
    """
    keys, inputs = list(group), list(inputs)
    if model is not None and model not in MODELS:
        raise ValueError(f"no model {model!r}; there are {', '.join(MODELS)}")
    tried = sorted([model] if model else models, key=MODELS.index)
    told = _ready(df, keys, unit, horizon, folds, inputs, future)
    tests = stored(_tests(told, keys, horizon, tried), "tests")
    e = F.col("predicted") - F.col("actual")
    means = tests.groupBy("_sid", "model", "_order").agg(F.avg(F.abs(e)).alias("mae"))
    # ties go to the simplest
    best = stored(means.groupBy("_sid").agg(F.min(F.struct("mae", "_order", "model")).alias("b")).select("_sid", "b.mae", "b.model"), "best")
    steps = tests.join(best, ["_sid", "model"]).groupBy("_sid", "step").agg(F.avg(e * e).alias("square"))
    near, so_far = Window.partitionBy("_sid").orderBy("step").rangeBetween(-2, 2), Window.partitionBy("_sid").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    widths = steps.withColumn("pooled", F.sqrt(F.avg("square").over(near))).withColumn("width", Z80 * F.max("pooled").over(so_far))
    widths = widths.groupBy("_sid").agg(F.sort_array(F.collect_list(F.struct("step", "width")))["width"].alias("widths"))
    state = told.state.where(F.col("cut") == F.col("n"))
    chosen = state.join(best.select(F.col("_sid").alias("sid"), "mae", F.col("model").alias("best")), "sid", "left").withColumn("best", F.coalesce("best", F.lit(model or "last value")))
    used = [r["best"] for r in chosen.select("best").distinct().collect()]
    out = None
    for m in used:
        own = chosen.where(F.col("best") == m)
        path = own.join(lockstep.paths(m, own, told.learned, told.shape, horizon).drop("cut"), "sid")
        out = path if out is None else out.unionByName(path)
    if out is None:
        out = chosen.withColumn("path", F.array().cast("array<double>"))
    each = out.join(widths.withColumnRenamed("_sid", "sid"), "sid", "left").select("*", F.posexplode("path").alias("k", "z"))
    tested = F.size("widths")
    width = F.when(F.col("k") < tested, F.get("widths", "k")).otherwise(F.element_at("widths", -1) * F.sqrt((F.col("k") + 1) / tested)) * F.lit(1.0)
    value = F.col("m") + F.col("s") * F.col("z")
    shown = [F.col(n).alias(c) for n, c in zip(told.names, keys, strict=True)]
    return each.select(*shown, F.col("best").alias("model"), F.get("dates", "k").alias("ts"), (F.col("k") + 1).alias("step"), value.alias("forecast"), (value - width).alias("low"), (value + width).alias("high"), F.col("mae").alias("backtest_mae"))


@dataclass
class Forecaster:
    """How a table is forecast: found once, applied to the same or to newer rows, and kept as JSON."""

    date: str
    value: str
    group: list[str]
    unit: str
    horizon: int
    combine: str = "sum"
    inputs: list[str] = field(default_factory=list)
    model: str | None = None
    leaderboard: list[dict] = field(default_factory=list)
    holidays: list[str] = field(default_factory=list)

    def history(self, df: DataFrame) -> DataFrame:
        """The regular series of a table, with its inputs and those that holidays give."""
        rows = series(df, self.date, self.value, self.group, self.unit, self.combine, self.inputs)
        return self._with_holidays(rows)

    def _with_holidays(self, rows: DataFrame) -> DataFrame:
        if not self.holidays:
            return rows
        days = rows.sparkSession.createDataFrame([(d,) for d in self.holidays], "day string")
        return holidays(rows, days).withColumns({c: F.col(c).cast("double") for c in HOLIDAY_INPUTS})

    def forecast(self, df: DataFrame, future: DataFrame | None = None, groups: list | None = None, horizon: int | None = None) -> DataFrame:
        """The next periods after df, which may be newer than what the model was chosen on.

        Rows of df after the last known value are plans, and so is future, of the same columns; groups: only these, of the
        first group column; an unknown one is an error.
        """
        if groups is not None:
            if not self.group:
                raise ValueError("this forecast has no groups")
            key = F.col(self.group[0])
            df = df.where(key.isin(*groups))
            gone = {str(g) for g in groups} - {str(r[0]) for r in df.select(key).distinct().limit(len(groups) + 1).collect()}
            if gone:
                raise ValueError(f"no such groups: {', '.join(sorted(gone))}")
        steps = horizon or self.horizon
        rows = self.history(df)
        names = [*self.inputs, *(HOLIDAY_INPUTS if self.holidays else ())]
        plan = None
        if self.inputs:
            pick = lambda d: d.select(*self.group, F.col(self.date).cast("timestamp_ntz").alias("ts"), *[c for c in self.inputs if c in d.columns])
            plan = pick(plans(df, self.date, self.value, self.group))
            if future is not None:
                plan = plan.unionByName(pick(future), allowMissingColumns=True)
        if self.holidays:
            spine = planned(rows, self.group, self.unit, steps, [])
            ahead = self._with_holidays(spine)
            plan = ahead if plan is None else plan.unionByName(ahead, allowMissingColumns=True)
        return forecast(rows, self.group, self.unit, steps, inputs=names, future=plan, model=self.model)

    def to_dict(self) -> dict:
        return dict(self.__dict__)


def fit_forecaster(df: DataFrame, date: str, value: str, group: list[str] = (), unit: str | None = None, horizon: int = 14, combine: str = "sum", inputs: list[str] = (), holiday_dates: list[str] = (), folds: int = 3, models: tuple[str, ...] = MODELS) -> Forecaster:
    """A Forecaster with one model for all groups, chosen by choose(), and its leaderboard."""
    out = Forecaster(date, value, list(group), unit or frequency(df, date).first()["unit"], horizon, combine, list(inputs), holidays=[str(d) for d in holiday_dates])
    names = [*out.inputs, *(HOLIDAY_INPUTS if out.holidays else ())]
    out.model, out.leaderboard = choose(out.history(df), out.group, out.unit, horizon, folds, names, models)
    return out


def beyond(width: Column, step: Column, horizon: int) -> Column:
    """A band's width past the backtested horizon: it grows with the square root of the step."""
    return F.when(step <= horizon, width).otherwise(width * F.sqrt(step / horizon))
