"""Training with text, several targets, weights, thresholds and combined models; every model is written and read again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import api
from tabulon.operators import drift, encode, train


@pytest.fixture(scope="module")
def rows(spark):
    """40 x 3 numbers, one of them as text, dates as text, and words that say the class."""
    return spark.sql("""select id, cast(id % 23 as double) as a, concat('$', cast(id * 7 % 31 as string), ',000') as price, date_format(date_add(date '2023-01-13', cast(id % 300 as int)), 'dd/MM/yyyy') as day,
    concat(case when id % 2 = 0 then 'parcel number ' else 'letter number ' end, cast(id as string), ' came very late') as note, case when id % 2 = 0 then 'yes' else 'no' end as y, id % 23 * 2.0 + id * 7 % 31 as z from range(240)""").persist()


def test_texts_and_text_numbers_are_inputs(spark, rows):
    e = encode.fit_auto(rows.drop("id", "y", "z"))
    assert set(e.inputs()) == {"a", "price", "day", "note"} and e.formats == {"price": "number", "day": "dd/MM/yyyy"}
    table = e.table(rows, ["id", "price"]).orderBy("id").collect()
    price = np.array([float(r["id"] * 7 % 31 * 1000) for r in table])
    assert [n for n, _ in e.columns()][:2] == ["a", "price"]
    got = e.table(rows, ["id"]).orderBy("id").toPandas()
    assert np.allclose(got["price"], (price - price.mean()) / price.std())
    # weights of a text as computed by hand
    notes = [("parcel" if k % 2 == 0 else "letter", "number", *([str(k)] if k > 9 else []), "came", "very", "late") for k in range(240)]
    df = {t: sum(t in n for n in notes) for n in notes for t in n}
    terms = e.texts["note"]["terms"]
    for k in (0, 7, 200):
        raw = {t: np.log(241 / (1 + df[t])) + 1 for t in notes[k] if t in terms}
        size = np.sqrt(sum(v * v for v in raw.values()))
        assert all(np.isclose(got[f"note~{t}"][k], raw.get(t, 0) / size) for t in terms)
    x = e.vectors(rows, ["id"]).first()["features"]
    assert len(x) == len(e.columns())
    gone = e.table(rows.drop("note", "price")).first()
    assert gone["note~late"] == 0 and gone["price"] is not None
    fitted = api.train(rows.drop("z"), "y", "id", ["baseline", "linear"], k=2)
    assert fitted.key == "linear" and fitted.leaderboard[0]["score"] > 0.99


@pytest.mark.parametrize("key", sorted(train.SPECS))
def test_models_are_written_and_read(spark, rows, tmp_path, key):
    target = "y" if train.CLASSIFICATION in train.SPECS[key].tasks else "z"
    table = rows.select("id", "a", F.regexp_extract("price", r"(\d+)", 1).cast("double").alias("b"), F.col(target) if target == "y" else (F.col("z") + 1).alias("z"))
    fitted = api.train(table, target, "id", [key], k=2)
    assert fitted.leaderboard[0]["error"] is None
    train.save(fitted, str(tmp_path / "m"))
    again = api.load_model(str(tmp_path / "m"))
    one, two = (m.predict(table).orderBy("id").toPandas() for m in (fitted, again))
    assert list(one.columns) == list(two.columns) and len(one) == 240
    for c in one.columns:
        assert (one[c] == two[c]).all() if one[c].dtype == object else np.allclose(one[c], two[c])
    assert again.leaderboard == fitted.leaderboard and again.encoding == fitted.encoding


def test_unknown_classes_are_not_loaded(spark, rows, tmp_path):
    fitted = api.train(rows.select("id", "a", "y"), "y", "id", ["baseline"], k=2)
    train.save(fitted, str(tmp_path / "m"))
    about = tmp_path / "m" / "about.json"
    about.write_text(about.read_text().replace("tabulon.operators.train.Baseline", "subprocess.Popen"))
    with pytest.raises(ValueError, match="not a model"):
        api.load_model(str(tmp_path / "m"))


def test_combined_models(spark, rows, tmp_path):
    table = rows.select("id", "a", (F.col("id") * 7 % 31).cast("double").alias("b"), "z")
    fitted = api.train(table, "z", "id", ["baseline", "linear", "tree", "knn"], k=2, combine=True)
    board = {r["model"]: r["score"] for r in fitted.leaderboard}
    assert {"ensemble", "stacking"} <= set(board) and board["stacking"] < board["tree"]
    models = [train._fit(train.make(k, "regression", 0, 2), fitted.encoding.vectors(table.withColumn("label", F.col("z")), ["label"]), False, False) for k in ("linear", "tree")]
    vectors = fitted.encoding.vectors(table, ["id"])
    each = [m.transform(vectors).orderBy("id").toPandas()["prediction"] for m in models]
    mean = train.Averaged(models, 0).transform(vectors).orderBy("id").toPandas()["prediction"]
    assert np.allclose(mean, (each[0] + each[1]) / 2)
    fitted.model, fitted.key = train.Stacked(models, train._top(0).fit(train.said(models, fitted.encoding.vectors(table.withColumn("label", F.col("z")), ["label"]), 0)), 0), "stacking"
    train.save(fitted, str(tmp_path / "s"))
    again = api.load_model(str(tmp_path / "s"))
    assert np.allclose(again.predict(table).orderBy("id").toPandas()["predicted"], fitted.predict(table).orderBy("id").toPandas()["predicted"])


def test_several_targets(spark, rows, tmp_path):
    labels = rows.select("id", "a", F.col("id").cast("double").alias("b"), (F.col("a") > 11).cast("int").alias("high"), (F.col("a") % 2 == 0).cast("int").alias("even"))
    fitted = api.train_many(labels, ["high", "even"], "id", models=["tree"], k=2)
    assert fitted.task == "multilabel"
    found = api.evaluate(fitted, labels)
    assert found["exact_match"] > 0.95 and found["hamming"] < 0.05
    train.save(fitted, str(tmp_path / "m"))
    out = api.load_model(str(tmp_path / "m")).predict(labels.drop("high", "even"))
    assert {"predicted_high", "predicted_even", "confidence_even"} <= set(out.columns)
    numbers = rows.select("id", "a", (F.col("a") * 2 + 0.5).alias("u"), (F.col("a") * -3 + 0.5).alias("v"))
    assert api.evaluate(api.train_many(numbers, ["u", "v"], "id", models=["linear"], k=2), numbers)["r2"] > 0.99


def test_rare_classes(spark):
    df = spark.sql("select id, cast(id * 7919 % 1000 as double) as a, cast(id * 31 % 97 as double) as b, case when id * 7919 % 1000 + id * 31 % 97 * 3 > 1080 then 'rare' else 'usual' end as y from range(1000)")
    options = {"plain": {}, "weights": {"class_weights": True}, "smote": {"smote": True}, "threshold": {"threshold": True}}
    found = {n: api.train(df, "y", "id", ["linear"], k=2, **o) for n, o in options.items()}
    recall = {n: m.predict(df).where("y = 'rare'").agg(F.avg((F.col("predicted") == "rare").cast("double"))).first()[0] for n, m in found.items()}
    assert recall["weights"] >= recall["plain"] and recall["smote"] >= recall["plain"]
    assert 0 < found["threshold"].threshold < 1
    weights = {r["label"]: r["weight"] for r in train.weighted(spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "label double")).collect()}
    assert weights == {0.0: 10 / 18, 1.0: 5.0}


def test_predictions_warn_of_drift(spark, rows):
    fitted = api.train(rows.select("id", "a", "day", "y"), "y", "id", ["baseline"], k=2)
    assert fitted.warning(rows) is None
    assert "a" in fitted.warning(rows.withColumn("a", F.col("a") + 40)) and fitted.warning(rows.drop("a")) and fitted.warning(rows.limit(5)) is None


def test_summary_equals_the_comparison(spark):
    old = spark.sql("select cast(id % 97 as double) as x, case when id % 9 = 0 then null else concat('c', cast(id % 70 as string)) end as c from range(2000)")
    new = spark.sql("select cast(id % 97 as double) * 1.3 as x, case when id % 4 = 0 then 'new' else concat('c', cast(id % 60 as string)) end as c from range(1500)")
    kept = drift.against(drift.summarise(old, ["x"], ["c"]), new).collect()
    want = {r["column"]: r for r in drift.numeric_drift(old, new, ["x"]).select("column", "psi", "outside", "status").unionByName(drift.category_drift(old, new, ["c"])).collect()}
    for r in kept:
        w = want[r["column"]]
        assert np.isclose(r["psi"], w["psi"]) and np.isclose(r["outside"], w["outside"]) and r["status"] == w["status"]


def test_fitting_reads_many_partitions(spark, tmp_path, monkeypatch):
    # a small file with many rows is one task's if read as it lies, and sorted shuffles of few bytes are joined to one
    spark.range(0, 4000, 1, 1).selectExpr("id", "id * 2.0 as a", "if(id % 3 = 0, 'x', 'y') as y").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(train, "ROWS", 500, raising=False)
    fitted_on = []
    monkeypatch.setattr(train, "_fit", lambda model, rows, *a, f=train._fit: fitted_on.append(rows.rdd.getNumPartitions()) or f(model, rows, *a))
    train.train(df, "y", "id", ["baseline"], k=2, encoding=encode.fit_encoding(df, ["a"], []))
    assert len(fitted_on) == 3 and min(fitted_on) == 8
