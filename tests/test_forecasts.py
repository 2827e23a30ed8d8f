"""Forecasts with inputs, plans, holidays, groups and newer history."""

import numpy as np
import pytest
from pyspark.ml import regression as R
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabulon import api
from tabulon.operators import forecast, lockstep


@pytest.fixture(scope="module")
def shops(spark):
    """Two shops, 150 days; a campaign every sixth day doubles what is sold. The last 12 days are plans."""
    return spark.sql("""select s as shop, timestamp_ntz '2023-03-01' + make_dt_interval(cast(k as int)) as day, cast(k % 6 = 0 as int) as campaign,
    case when k < 138 then (100.0 + 20 * (k % 7)) * (case when s = 'east' then 1 else 5 end) * (case when k % 6 = 0 then 2 else 1 end) end as sold
    from range(150) t(k), (values ('east'), ('west')) u(s)""").persist()


def test_planned_inputs(spark, shops):
    rows = forecast.series(shops, "day", "sold", ["shop"], "day", inputs=["campaign"])
    future = spark.sql("select 'east' as shop, timestamp_ntz '2023-07-18' as ts, 1 as campaign")
    got = {(r["shop"], r["ts"].day): r["campaign"] for r in forecast.planned(rows, ["shop"], "day", 3, ["campaign"], future).collect()}
    # 2023-07-16 is the last known day; day 137 has no campaign; a plan holds until the next one
    assert got == {("east", 17): 0.0, ("east", 18): 1.0, ("east", 19): 1.0, ("west", 17): 0.0, ("west", 18): 0.0, ("west", 19): 0.0}
    assert forecast.planned(rows, ["shop"], "day", 3, []).count() == 6


def test_plans_move_the_forecast(shops):
    out = api.forecast(shops, "day", "sold", ["shop"], "day", 12, inputs=["campaign"], model="boosting").orderBy("shop", "step").toPandas()
    truth = np.array([(100 + 20 * (k % 7)) * (2 if k % 6 == 0 else 1) for k in range(138, 150)])
    for shop, scale in (("east", 1), ("west", 5)):
        own = out[out["shop"] == shop]["forecast"].to_numpy()
        assert len(own) == 12 and np.abs(own / scale - truth).mean() < 45
        assert own[0] / scale > 250 and own[6] / scale > 250
    blind = api.forecast(shops.drop("campaign"), "day", "sold", ["shop"], "day", 12, model="boosting").where("shop = 'east'").orderBy("step").toPandas()["forecast"]
    assert np.abs(blind - truth).mean() > np.abs(out[out["shop"] == "east"]["forecast"].to_numpy() - truth).mean()


def test_one_model_for_all_groups(spark, shops, tmp_path):
    fitted = api.fit_forecast(shops, "day", "sold", group=["shop"], horizon=7, inputs=["campaign"], folds=2)
    assert {r["model"] for r in fitted.leaderboard} == set(forecast.MODELS) and fitted.leaderboard[0]["model"] == fitted.model != "last value"
    assert [r["relative"] for r in fitted.leaderboard] == sorted(r["relative"] for r in fitted.leaderboard)
    tests = forecast.backtest(fitted.history(shops), ["shop"], "day", 7, 2, ["campaign"], ("last value", "last season")).toPandas()
    base = tests[tests["model"] == "last value"]
    assert (base["predicted"] == base["naive"]).all()
    relative = {r["model"]: r["relative"] for r in fitted.leaderboard}
    per = [np.abs(p["predicted"] - p["actual"]).mean() / np.abs(p["naive"] - p["actual"]).mean() for _, p in tests[tests["model"] == "last season"].groupby("shop")]
    assert np.isclose(relative["last season"], np.mean(per)) and np.isclose(relative["last value"], 1)
    api.save_forecaster(fitted, str(tmp_path / "f.json"))
    again = api.load_forecaster(str(tmp_path / "f.json"))
    assert again == fitted
    newer = shops.withColumn("day", F.expr("day + interval 400 days"))
    out = again.forecast(newer, groups=["west"])
    assert {r["shop"] for r in out.select("shop").distinct().collect()} == {"west"} and out.agg(F.min("ts")).first()[0].year == 2024 and out.count() == 7
    with pytest.raises(ValueError, match="north"):
        again.forecast(shops, groups=["west", "north"])
    sums = {r["ts"]: r["forecast"] for r in forecast.totals(again.forecast(shops)).collect()}
    parts = again.forecast(shops).toPandas().groupby("ts")["forecast"].sum()
    assert len(sums) == 7 and all(np.isclose(sums[t.to_pydatetime()], v) for t, v in parts.items())


def test_holidays_are_inputs(spark):
    free = [f"2023-{m:02d}-{d:02d}" for m in range(1, 10) for d in (4, 19)]
    days = spark.createDataFrame([(d,) for d in free], "h string").select(F.to_date("h").alias("h"))
    df = spark.sql("select timestamp_ntz '2023-01-01' + make_dt_interval(cast(id as int)) as day, 50.0 as v from range(245)").join(F.broadcast(days), F.to_date("day") == F.col("h"), "left").select("day", F.when(F.col("h").isNotNull(), 500.0).otherwise(F.col("v")).alias("v"))
    out = api.forecast(df, "day", "v", horizon=7, holidays=free, model="ridge").orderBy("step").toPandas()
    assert out["ts"].dt.day.tolist() == [3, 4, 5, 6, 7, 8, 9] and out["forecast"].idxmax() == 1 and out["forecast"][1] > 350


def test_bands_grow_past_what_was_tested(spark):
    df = spark.sql("select timestamp_ntz '2023-01-01' + make_dt_interval(cast(id as int)) as day, cast(id * 7919 % 13 as double) as v from range(40)")
    out = api.forecast(df, value="v", horizon=30, model="last value").orderBy("step").toPandas()
    width = (out["high"] - out["forecast"]).to_numpy()
    assert (np.diff(width) >= 0).all() and np.isclose(width[29], width[9] * np.sqrt(3))


def test_dates(spark):
    df = spark.sql("select id, date_format(date_add(date '2024-01-20', cast(id as int)), 'dd/MM/yyyy') as when, cast(id % 5 as double) as v from range(60)")
    assert api.date_column(df) == "when" and api.forecast(df, value="v", horizon=2).count() == 2
    with pytest.raises(ValueError, match="no date column"):
        api.date_column(df.drop("when"))
    steps = spark.sql("select timestamp_ntz '2024-01-31' as a, timestamp_ntz '2024-03-01' as b").select(*[forecast.periods_between(F.col("a"), F.col("b"), u).alias(u) for u in ("day", "week", "month", "year")], forecast.periods_between(F.col("b"), F.col("a"), "month").alias("back")).first()
    assert steps.asDict() == {"day": 30, "week": 4, "month": 2, "year": 0, "back": -2}


def test_ridge_leaves_one_out():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 * rng.standard_normal(60) + 4
    w, b = lockstep.ridge(x, y)
    losses, fits = [], []
    for a in lockstep.ALPHAS:
        def solve(xs, ys, a=a):
            m, s = x.mean(0), x.std(0)
            z = np.column_stack([np.ones(len(xs)), (xs - m) / s])
            c = np.linalg.solve(z.T @ z + np.diag([0, a, a, a]), z.T @ ys)
            return c[1:] / s, c[0] - (m / s) @ c[1:]
        fits.append(solve(x, y))
        held = [solve(np.delete(x, k, 0), np.delete(y, k)) for k in range(60)]
        losses.append(np.mean([(y[k] - x[k] @ v - c) ** 2 for k, (v, c) in enumerate(held)]))
    best = fits[int(np.argmin(losses))]
    assert np.allclose(w, best[0]) and np.isclose(b, best[1])


def test_steps_are_appended(spark):
    """A line that adds its first lag and mean, by hand; histories shorter than a lag begin with their first value."""
    state = spark.sql("select 's' as sid, 5 as cut, array(1.0D, 2.0D, 4.0D) as hist, array(array(10.0D), array(20.0D)) as xs, array(0.5D, 0.1D, 1.0D, 0.0D, 0.01D) as w, 0.25D as b")
    got = lockstep.roll(state, lockstep.Shape([1, 4], [2], 1), 2).first()["path"]
    one = 0.25 + 0.5 * 4 + 0.1 * 1 + 3 + 0.1
    assert np.allclose(got, [one, 0.25 + 0.5 * one + 0.1 * 1 + (4 + one) / 2 + 0.2])


@pytest.mark.parametrize("kind", [lambda: R.GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.3), lambda: R.RandomForestRegressor(numTrees=3, maxDepth=4)], ids=["boosting", "forest"])
def test_trees_answer_as_their_model(spark, kind):
    x = np.random.default_rng(3).random((300, 3))
    df = spark.createDataFrame([(float(a + (b > 0.4) * c), Vectors.dense([a, b, c])) for a, b, c in x.tolist()], ["label", "features"])
    fitted = kind().fit(df)
    want = [r["prediction"] for r in fitted.transform(df).collect()]
    assert np.allclose(lockstep._answers(lockstep.nodes_of(fitted), x), want)


def test_long_horizons_and_null_groups(spark):
    df = spark.sql("select timestamp_ntz '2023-01-01' + make_dt_interval(cast(id as int)) as day, g, 10.0 + id % 7 + coalesce(g, 0) * 100 as v from range(90), (values (1), (2), (null)) t(g)")
    out = api.forecast(df, "day", "v", ["g"], "day", 40).toPandas()
    assert len(out) == 120 and out["g"].isna().sum() == 40
    for g, part in out.groupby("g", dropna=False):
        truth = 10 + np.arange(90, 130) % 7 + (0 if g != g else g * 100)
        assert np.abs(part.sort_values("step")["forecast"].to_numpy() - truth).max() < 1e-6


def test_short_series(spark):
    df = spark.sql("select timestamp_ntz '2023-01-01' + make_dt_interval(cast(id as int)) as day, 7.0 as v from range(3)")
    out = api.forecast(df, "day", "v", unit="day", horizon=4).toPandas()
    assert out["forecast"].tolist() == [7.0] * 4 and out["model"].unique().tolist() == ["last value"] and out["low"].isna().all()
    with pytest.raises(ValueError, match="no model"):
        api.forecast(df, "day", "v", unit="day", model="oracle")
