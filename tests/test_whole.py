"""Registered queries without SQL, against plain versions in NumPy and pandas, and that queries read whole tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import anomaly, forecast, importance
from tabulon.plans import queries


def got(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).toPandas()


def read(spark, sf_dir, name):
    return queries.table(spark, sf_dir, name).toPandas()


def test_lof_has_the_operators_own_reference(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(anomaly, "local_outlier_factor", lambda rows, *a, **b: seen.append((a, b)) or rows)
    queries.QUERIES["anomaly_lof"](spark, sf_dir)
    assert seen == [((["c_acctbal", "c_nationkey"], "c_custkey"), {})]


def test_series_hold_all_orders(spark, sf_dir):
    sums = got(spark, sf_dir, "series_regular")
    orders = read(spark, sf_dir, "orders")
    assert sums.loc[~sums["filled"], "y"].sum() == pytest.approx(orders["o_totalprice"].sum())
    assert sums["filled"].any()


def test_next_values(spark, sf_dir):
    out = got(spark, sf_dir, "forecast_next")
    history = forecast.series(queries.table(spark, sf_dir, "orders").selectExpr("o_orderpriority as g", "o_orderdate as d", "o_totalprice as v"), "d", "v", ["g"], "day").toPandas()
    assert set(out["g"]) == set(history["g"]) and (out.groupby("g")["step"].apply(list).map(lambda s: sorted(s) == list(range(1, 15)))).all()
    assert (out["low"] <= out["forecast"]).all() and (out["forecast"] <= out["high"]).all()
    # the model that forecasts is no worse on the last three fortnights than the last value and the last week are
    series_ = queries._series(spark, sf_dir).toPandas().sort_values("ts")
    for g, own in series_.groupby("g"):
        y = own["y"].to_numpy()
        cuts = [len(y) - 14 * k for k in (1, 2, 3)]
        naive = np.mean([np.abs(y[c : c + 14] - y[c - 1]).mean() for c in cuts])
        week = np.mean([np.abs(y[c : c + 14] - np.resize(y[c - 7 : c], 14)).mean() for c in cuts])
        assert out.loc[out["g"] == g, "backtest_mae"].iloc[0] <= min(naive, week) + 1e-9


def test_kinds(spark, sf_dir):
    out, orders = got(spark, sf_dir, "profile_kinds").set_index("column"), read(spark, sf_dir, "orders")
    assert out["n_unique"].to_dict() == orders.nunique().to_dict() and (out["n_missing"] == 0).all()
    assert out["kind"].to_dict() == {"o_orderkey": "id", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical"}


def test_issues(spark, sf_dir):
    out = got(spark, sf_dir, "profile_issues")
    rows = queries.dirty(spark, sf_dir).toPandas()
    assert set(zip(out["code"], out["column"], strict=True)) >= {("dropped", "id"), ("dropped", "nothing")}
    shares = rows["churned"].value_counts(normalize=True)
    assert ("imbalance" in set(out["code"])) == (shares.min() < 0.2 and shares.max() / shares.min() > 3 or shares.max() / shares.min() > 10)


def test_clean_all(spark, sf_dir):
    out, rows = got(spark, sf_dir, "clean_all"), queries.dirty(spark, sf_dir).toPandas()
    tokens = set(queries.values.MISSING)
    text = lambda s: s.map(lambda v: None if v is None or v.strip().lower() in tokens else v.strip())
    segment, income = text(rows["segment"]), text(rows["income"])
    number = income.map(lambda v: None if v is None else -float(v[1:-1]) if v.startswith("(") else float(v.replace("$", "").replace(",", "")))
    counts = segment.value_counts()
    best = {f: min((v for v in counts.index if v.lower() == f), key=lambda v: (-counts[v], v)) for f in {v.lower() for v in counts.index}}
    segment = segment.map(lambda v: None if v is None else best[v.lower()])
    plain = pd.DataFrame({"segment": segment, "income": number.astype(float), "balance": rows["balance"].astype(float), "churned": rows["churned"]})
    for c in ("income", "balance"):
        a, b = plain[c].quantile(0.25), plain[c].quantile(0.75)
        plain[c] = plain[c].clip(a - 1.5 * (b - a), b + 1.5 * (b - a))
        plain[c] = plain[c].fillna(plain[c].median())
    counts = plain["segment"].value_counts()
    plain["segment"] = plain["segment"].fillna(min(counts.index, key=lambda v: (-counts[v], v)))
    # every customer has another id, which goes only after equal rows have gone
    assert len(out) == len(plain) and set(out.columns) == set(plain.columns)
    order = lambda d: d.sort_values(["segment", "income", "balance", "churned"]).reset_index(drop=True)
    one, two = order(out[plain.columns]), order(plain)
    assert (one["segment"] == two["segment"]).all() and (one["churned"] == two["churned"]).all()
    assert np.allclose(one["income"], two["income"]) and np.allclose(one["balance"], two["balance"])


def test_lof(spark, sf_dir):
    out, rows = got(spark, sf_dir, "anomaly_lof").set_index("c_custkey")["lof"], read(spark, sf_dir, "customer")
    x = rows[["c_acctbal", "c_nationkey"]].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :20]
    dist = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    want = density[near].mean(1) / density
    assert np.allclose(out.loc[rows["c_custkey"]].to_numpy(), want, rtol=1e-6)


def test_forest(spark, sf_dir):
    out, rows = got(spark, sf_dir, "anomaly_forest").set_index("c_custkey")["iforest"], read(spark, sf_dir, "customer").set_index("c_custkey")
    assert len(out) == len(rows) and out.between(0, 1).all()
    # corners are isolated sooner than the middle
    x = (rows[["c_acctbal", "c_nationkey"]] - rows[["c_acctbal", "c_nationkey"]].mean()) / rows[["c_acctbal", "c_nationkey"]].std()
    far = (x**2).sum(axis=1)
    assert out.rank().corr(far.reindex(out.index).rank()) > 0.6


def test_kmeans(spark, sf_dir):
    out = got(spark, sf_dir, "cluster_kmeans")
    rows = queries._grouped(spark, sf_dir).toPandas().merge(out, on="c_custkey")
    x = rows[["c_acctbal", "nation"]].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    label = rows["cluster"].to_numpy()
    cost = lambda at: sum(((x[at == k] - x[at == k].mean(0)) ** 2).sum() for k in np.unique(at))
    rng, best = np.random.default_rng(0), np.inf
    for _ in range(20):
        centres = x[rng.choice(len(x), 3, False)]
        for _ in range(50):
            at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(3)])
        best = min(best, cost(at))
    assert set(label) == {0, 1, 2} and cost(label) <= 1.1 * best and (np.diff(np.bincount(label)) <= 0).all()


def test_redundancy(spark, sf_dir):
    out = got(spark, sf_dir, "importance_redundancy").set_index("column")["vif"]
    x = read(spark, sf_dir, "lineitem")[list(queries._COLS)].to_numpy(float)
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert np.allclose([out[c] for c in queries._COLS], want, rtol=1e-6)


def test_forest_importance(spark, sf_dir):
    out = got(spark, sf_dir, "importance_forest").set_index("column")["score"]
    assert out["o_totalprice"] > 0.3 and out["o_custkey"] < 0.1 * out["o_totalprice"]


def test_training_queries(spark, sf_dir):
    board = got(spark, sf_dir, "train_compare").set_index("model")["score"]
    y = np.where(read(spark, sf_dir, "customer")["c_acctbal"] > 4000, 1, 0)
    share = max(y.mean(), 1 - y.mean())
    assert min(board["tree"], board["linear"]) > 0.95 > board["baseline"]
    assert abs(board["baseline"] - share / (1 + share)) < 0.02
    out, part = got(spark, sf_dir, "train_predict").set_index("p_partkey")["predicted"], read(spark, sf_dir, "part")
    x = np.column_stack([np.ones(len(part)), part["p_size"], pd.get_dummies(part["p_brand"]).to_numpy(float)]).astype(float)
    price = part["p_retailprice"].to_numpy()
    fitted = x @ np.linalg.lstsq(x, price, rcond=None)[0]
    mine = out.loc[part["p_partkey"]].to_numpy()
    # the better one in cross-validation: the line, or the mean
    assert np.allclose(mine, fitted, rtol=1e-3) or np.allclose(mine, price.mean())


def test_fingerprint(spark, sf_dir):
    one = got(spark, sf_dir, "table_fingerprint")["fingerprint"][0]
    assert one == got(spark, sf_dir, "table_fingerprint")["fingerprint"][0] and len(one) == 16
    nation = queries.table(spark, sf_dir, "nation")
    assert queries.writers.fingerprint(nation.orderBy(F.desc("n_name")).repartition(3)) == one != queries.writers.fingerprint(nation.where("n_nationkey > 0"))


def test_redundancy_ranks_by_counts_of_values(spark, monkeypatch):
    methods = []
    corr = importance.Correlation.corr
    monkeypatch.setattr(importance.Correlation, "corr", staticmethod(lambda df, c, method: methods.append(method) or corr(df, c, method)))
    df = spark.sql("select id % 7 as a, case when id % 5 > 0 then cast(id * id % 101 as double) end as b, exp(id % 7 + id % 3) as c from range(500)")
    _, pairs, vif = importance.redundancy(df, ["a", "b", "c"], 0.0)
    want = df.toPandas().fillna(0.0).rank().corr()
    assert len(pairs) == 3 and all(abs(r - want.loc[a, b]) < 1e-9 for a, b, r in pairs)
    # Spark's own Spearman numbers and sorts all rows of each column
    assert methods == ["pearson"] and set(vif) == {"a", "b", "c"}
