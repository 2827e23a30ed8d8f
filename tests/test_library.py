"""Operators on small made tables: sources, writers, series, anomalies, groups, training, runs and streams."""

import gzip
import io
import json
import lzma
import math
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import api
from tabulon.functions import metrics
from tabulon.operators import anomaly, clean, cluster, drift, encode, forecast, importance, splits, train
from tabulon.plans import report, runs, serve
from tabulon.sources import readers, writers
from tabulon.streaming import chunks

ROWS = [("a", 1.5), ("b", 2.0), ("é", None)]


def text(sep=","):
    return "\n".join([f"name{sep}x", *[f"{n}{sep}{'' if x is None else x}" for n, x in ROWS]]) + "\n"


def same(df):
    return sorted((r[0], r[1]) for r in df.select("name", F.col("x").cast("double")).na.fill(-1.0, ["x"]).collect()) == sorted((n, -1.0 if x is None else x) for n, x in ROWS)


@pytest.mark.parametrize(("name", "raw"), [
    ("a.csv", text().encode()), ("b.csv", b"\xef\xbb\xbf" + text().encode()), ("c.csv", text().encode("cp1252")), ("d.csv", text(";").encode()), ("e.tsv", text("\t").encode()),
    ("f.csv.gz", gzip.compress(text().encode())), ("g.csv.xz", lzma.compress(text().encode())), ("h.json", json.dumps([{"name": n, "x": x} for n, x in ROWS]).encode()),
    ("i.json", "\n".join(json.dumps({"name": n, "x": x}) for n, x in ROWS).encode()), ("j.jsonl", "\n".join(json.dumps({"name": n, "x": x}) for n, x in ROWS).encode()),
])
def test_text_sources(spark, tmp_path, name, raw):
    (tmp_path / name).write_bytes(raw)
    assert same(api.load(spark, str(tmp_path / name)))


def test_other_sources(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x.csv", text())
    (tmp_path / "x.csv.zip").write_bytes(buffer.getvalue())
    assert same(api.load(spark, str(tmp_path / "x.csv.zip")))
    df = api.load(spark, str(tmp_path / "x.csv.zip"))
    for name in ("y.parquet", "y.xlsx", "y.orc"):
        assert same(api.load(spark, writers.save(df, str(tmp_path / name))))
    import pyarrow.feather as feather

    feather.write_feather(df.toArrow(), str(tmp_path / "z.feather"))
    assert same(api.load(spark, str(tmp_path / "z.feather")))
    with sqlite3.connect(tmp_path / "t.db") as con:
        con.execute("create table t (name text, x real)")
        con.executemany("insert into t values (?, ?)", ROWS)
    assert same(api.load(spark, f"sqlite:///{tmp_path}/t.db".replace("sqlite:////", "sqlite:////"), table="t"))
    assert api.load(spark, df, sample=2).count() == 2


def test_source_errors(spark, tmp_path):
    for bad in ("x.unknown", "sqlite:///nothing.db"):
        with pytest.raises(readers.SourceError):
            api.load(spark, bad)
    with pytest.raises(readers.SourceError):
        api.load(spark, spark.createDataFrame([], "x int"))
    assert readers.describe("postgresql://u:secret@h/d") == "postgresql://u:***@h/d" and readers.stem("/a/b.csv.gz?x") == "b"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "name string, x double")
    assert writers.fingerprint(df) == writers.fingerprint(df.orderBy(F.desc("name"))) != writers.fingerprint(df.limit(2))
    writers.append(df, str(tmp_path / "p"))
    writers.append(df.withColumn("x", F.col("x").cast("float")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    assert writers.plain({"a": float("nan"), 1: np.float64(2), "t": (1, {2})}) == {"a": None, "1": 2.0, "t": [1, [2]]}


def test_clean(spark):
    rows = [(k, "male " if k % 3 else "Male", "N/A" if k == 4 else f"${k},000", f"{k % 28 + 1:02d}/0{k % 9 + 1}/2024", None, "yes" if k % 2 else "no") for k in range(1, 40)]
    df = spark.createDataFrame([*rows, rows[0], (None,) * 6], '` id ` long, gender string, price string, `when` string, empty string, y string')
    out = clean.clean(df, "y", fill=True)
    # id counts rows; gender has one spelling left, so it is kept as the constant that it was not before
    assert out.data.columns == ["gender", "price", "when", "y"] and {r["gender"] for r in out.data.collect()} == {"male"}
    assert dict(out.data.dtypes)["price"] == "double" and dict(out.data.dtypes)["when"] == "timestamp_ntz" and "empty" not in out.data.columns
    assert out.data.where("price is null").count() == 0 and out.data.count() == 39
    with pytest.raises(ValueError):
        clean.clean(df, outliers="bad")


def test_drift(spark):
    old = spark.range(400).select((F.col("id") % 50).cast("double").alias("age"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("plan"))
    assert api.compare_drift(old, old)[1] == "stable"
    new = old.select((F.col("age") + 30).alias("age"), F.when(F.rand(1) < 0.3, "new").otherwise(F.col("plan")).alias("plan"))
    table, verdict = api.compare_drift(old, new)
    assert verdict == "major" and {r["status"] for r in table.collect()} == {"major"}
    assert "age" in drift.warning(old, new, ["age"]) and drift.warning(old, new.limit(5), ["age"]) is None
    assert api.compare_drift(old, new.drop("plan"))[0].where("status = 'missing'").count() == 1


def test_trend_is_continued(spark):
    df = spark.sql("select timestamp_ntz '2022-01-01' + make_dt_interval(cast(id as int)) as d, 40 + 3.5 * id as v from range(450)")
    out = api.forecast(df, "d", "v", horizon=3).orderBy("step").collect()
    assert [abs(r["forecast"] - (1615 + 3.5 * k)) < 10 for k, r in enumerate(out)] == [True] * 3 and all(r["low"] <= r["forecast"] <= r["high"] for r in out)


def test_series(spark):
    df = spark.sql("select g, timestamp_ntz '2024-01-01' + make_dt_interval(cast(k as int)) as d, case when k < 20 then cast(k as double) end as v from range(25) t(k), (values ('a'), ('b')) u(g) where k not in (3, 4)")
    out = forecast.series(df, "d", "v", ["g"]).where("g = 'a'").orderBy("t").collect()
    assert [r["y"] for r in out] == list(map(float, range(20))) and [r["t"] for r in out if r["filled"]] == [3, 4]
    assert forecast.plans(df, "d", "v", ["g"]).count() == 10
    unit = lambda step: forecast.frequency(spark.sql(f"select timestamp_ntz '2020-01-01' + {step} as d from range(40)"), "d").first()["unit"]
    assert [unit("make_dt_interval(0, cast(id as int))"), unit("make_dt_interval(cast(id * 7 as int))"), unit("make_ym_interval(0, cast(id as int))"), unit("make_ym_interval(0, cast(id * 3 as int))"), unit("make_ym_interval(cast(id as int))")] == ["hour", "week", "month", "quarter", "year"]
    short = forecast.forecast(forecast.series(df.limit(2), "d", "v", ["g"]), ["g"], "day", 2)
    assert short.count() >= 2


def test_anomalies(spark):
    df = spark.sql("select id, case when id < 16 then 5000.0 + id else 50 + id % 17 end as amount, id % 24 as hour, case when id % 5 = 0 then 'x' else 'y' end as country from range(800)")
    out = api.anomalies(df, "id", 0.02)
    hits = {r["id"] for r in out.where("is_anomaly").collect()}
    assert len(hits & set(range(16))) >= 14 and len(hits) <= 24
    assert "amount" in out.where("id = 3").first()["reasons"]
    lof = anomaly.local_outlier_factor(df, ["amount", "hour"], "id").orderBy(F.desc("lof")).limit(16)
    assert lof.count() == 16


def test_groups(spark):
    df = spark.sql("select id, case when id < 120 then 0 when id < 210 then 50 else 100 end + id % 7 as a, case when id < 120 then 0 when id < 210 then 80 else 10 end + id % 5 as b from range(270)")
    df = df.select("id", F.col("a").cast("double"), F.col("b").cast("double"))
    out = api.groups(df, "id", range(2, 5))
    assert sorted(r["count"] for r in out.groupBy("cluster").count().collect()) == [60, 90, 120]
    again = cluster.assign_by_neighbours(df, out, ["a", "b"], "cluster", "id")
    assert again.count() == 270


def test_training(spark, tmp_path):
    df = spark.sql("select id, id % 40 + id % 3 as x, (id * 7919) % 11 as noise, case when id % 5 = 0 then 'p' else 'q' end as c, case when id % 40 > 20 then 'yes' else 'no' end as y from range(400)")
    fitted = api.train(df, "y", "id", ["baseline", "tree", "lda", "xgboost"], k=2)
    assert fitted.key in ("tree", "lda") and fitted.leaderboard[0]["score"] > 0.9 and "xgboost" in fitted.skipped
    scored = fitted.predict(df.drop("y").withColumn("extra", F.lit(1)))
    assert {"predicted", "confidence", "probability_yes", "extra"} <= set(scored.columns) and scored.count() == 400
    train.save(fitted, str(tmp_path / "m"))
    again = api.load_model(str(tmp_path / "m"))
    assert api.evaluate(again, df, "y")["accuracy"] > 0.9
    assert len(serve.score_records(spark, again, [{"x": 30, "c": "p"}, {"x": 1}])) == 2
    with pytest.raises(ValueError):
        serve.score_records(spark, again, [{"z": 1}])
    assert api.explain(fitted, df, "id", 2).count() == 2 * len(set(c for _, c in fitted.encoding.columns()))
    (tmp_path / "in").mkdir()
    df.write.parquet(str(tmp_path / "in" / "one"))
    api.predict_chunks(spark, again, str(tmp_path / "in" / "one"), df, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_regression_and_tuning(spark):
    df = spark.sql("select id, cast(id % 50 as double) as x, 3.0 * (id % 50) + id % 2 as y from range(300)")
    fitted = api.train(df, "y", "id", ["baseline", "linear"], k=2)
    assert fitted.key == "linear" and api.evaluate(fitted, df, "y")["r2"] > 0.99
    again = api.train(df.withColumn("y", F.exp(F.col("x") / 8)), "y", "id", ["linear"], k=2, log_target=True)
    plain = api.train(df.withColumn("y", F.exp(F.col("x") / 8)), "y", "id", ["linear"], k=2)
    assert again.leaderboard[0]["score"] < plain.leaderboard[0]["score"] / 2
    with pytest.raises(ValueError, match="log target"):
        api.train(df.withColumn("y", F.col("y") - 50), "y", "id", ["linear"], k=2, log_target=True)
    rows = splits.folds(fitted.encoding.vectors(df.withColumn("label", F.col("y")), ["id", "label"]), "id", 2)
    assert len(train.tune(rows, "ridge", "regression", 0, 1, "rmse", trials=2, k=2)) == 2


def test_importance(spark):
    df = spark.sql("select id, cast(id % 37 as double) as a, cast((id * 31) % 29 as double) as noise, 2.0 * (id % 37) as copy, case when id % 37 > 18 then 'yes' else 'no' end as y from range(500)")
    table = api.importance(df.drop("id"), "y").orderBy("consensus_rank").collect()
    assert table[-1]["column"] == "noise" and api.select(df.drop("id"), "y", 1)[0] in ("a", "copy")
    groups, pairs, vif = importance.redundancy(df, ["a", "noise", "copy"])
    assert groups == [["a", "copy"]] and len(pairs) == 1 and vif["noise"] < 1.5
    points = [(2, 0.61), (4, 0.8), (6, 0.795), (9, 0.83), (12, 0.834)]
    assert importance.enough(points) == 9 and importance.enough(points, spreads={12: 0.04}) == 4
    mixed = importance.shuffled(df, ["a"]).collect()
    assert len(mixed) == 500 and sorted(r["a"] for r in mixed) == sorted(r["shuffled_a"] for r in mixed) and any(r["a"] != r["shuffled_a"] for r in mixed)
    best = importance.search(["a", "noise"], lambda s: 1.0 * ("a" in s) - 0.1 * len(s))
    assert best[0][0] == ["a"] and len(importance.search(["a", "b"], len, "exhaustive")) == 3


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    r = metrics.ranking(df).first()
    assert math.isclose(r["roc_auc"], 0.625)
    assert metrics.metric_name("AUC") == "roc_auc" and metrics.overfit(0.99, 0.6, True) and metrics.weak_signal("r2", 0.01)
    with pytest.raises(ValueError):
        metrics.metric_name("nonsense")


def test_psi(spark):
    rows = spark.createDataFrame([("c", 0.9, 0.9), ("c", 0.1, 0.1), ("d", 0.9, 0.1), ("d", 0.1, 0.9)], "column string, e double, a double")
    got = {r["column"]: r["psi"] for r in drift.psi("e", "a", ["column"], rows).collect()}
    assert got["c"] == 0 and got["d"] > 0.25


def test_holdout(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 3)
    for share, n in ((0.2, 200), (0.0, 0), (1.0, 1000)):
        assert splits.holdout(df, "id", share=share).where("is_test").count() == n
    want = {r["id"] for r in df.orderBy(splits.place("id", 42)).limit(200).collect()}
    assert {r["id"] for r in splits.holdout(df, "id").where("is_test").collect()} == want
    assert splits.holdout(df, "id", "y").where("is_test").count() == 198


def test_encoding(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, c string")
    e = encode.fit_encoding(df, ["x"], ["c"])
    assert [n for n, _ in e.columns()] == ["x", "x__missing", "c=(missing)", "c=a", "c=b"]
    assert e.table(df.drop("c")).first()["c=(missing)"] == 1.0
    assert encode.missing_columns(df, ["x", "z"]) == ["z"]
    with pytest.raises(ValueError):
        encode.missing_columns(df, ["x", "z"], strict=True)


def test_runs(tmp_path):
    import datetime

    now = datetime.datetime(2024, 5, 1, 12)
    one = runs.create(tmp_path, "My data!", now)
    two = runs.create(tmp_path, "My data!", now)
    assert (one.name, two.name) == ("20240501-120000_my-data", "20240501-120000_my-data-2")
    for p, f in ((one, "x"), (two, "y")):
        runs.save(p, {"target": "t", "fingerprint": f})
    assert runs.resolve(tmp_path, "latest") == two and len(runs.listed(tmp_path)) == 2
    assert any(r["attribute"] == "note" for r in report.compare_runs(runs.listed(tmp_path)))
    assert runs.prune(tmp_path, keep=1) == [one.name] and not one.exists()
    (tmp_path / "c.yml").write_text("data: x.csv\ntarget: y # note\nmodels: [a, b]\n")
    assert runs.load_config(tmp_path / "c.yml") == {"data": str(tmp_path / "x.csv"), "target": "y", "models": ["a", "b"]}
    (tmp_path / "d.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        runs.load_config(tmp_path / "d.json")
    assert "<td>&lt;b&gt;</td>" in report.html_table([{"a": "<b>"}])


def test_stream_resampling(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01' + make_dt_interval(0, cast(id as int)) as ts, 1.0 as v from range(72)").write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    out = chunks.resample(chunks.stream(spark, str(tmp_path / "in"), like), "ts", "v")
    chunks.write_table(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert chunks.resample(like, "ts", "v").count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() <= 3
