"""Importance of all kinds of columns by all methods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import api
from tabulon.operators import ranking


@pytest.fixture(scope="module")
def rows(spark):
    """A colour and a number decide the class; noise and a word don't."""
    return spark.sql("""select cast((id * 7919) % 101 as double) as a, cast((id * 104729) % 97 as double) as noise, element_at(array('red', 'green', 'blue'), cast((id * 31) % 3 + 1 as int)) as colour,
    element_at(array('u', 'v'), cast((id * 17) % 7 % 2 + 1 as int)) as word, date_add(date '2024-01-01', cast(id % 50 as int)) as day,
    case when (id * 31) % 3 = 0 or (id * 7919) % 101 > 95 then 'yes' else 'no' end as y, 3.0 * ((id * 31) % 3) + 0.01 * ((id * 7919) % 101) as z from range(300)""").persist()


def test_a_category_wins(spark, rows):
    df = spark.sql("select cast(id * 7919 % 101 as double) as noise, element_at(array('red', 'green'), cast(id % 2 + 1 as int)) as colour, case when id % 2 = 0 then 'yes' else 'no' end as y from range(400)")
    assert api.select(df, "y", 1) == ["colour"] and {r["column"] for r in api.importance(df, "y").collect()} == {"colour", "noise"}
    assert api.select(rows, "z", 1) == ["colour"]
    with pytest.raises(ValueError, match="no method guess"):
        api.importance(df, "y", ["guess"])
    with pytest.raises(ValueError, match="no classes"):
        api.importance(rows, "z", ["mi"])


@pytest.fixture(scope="module")
def tables(rows):
    return {"y": ranking.encoded(rows.drop("z", "day"), "y"), "z": ranking.encoded(rows.drop("y", "day"), "z")}


#: Those that fit many models are tried on one target only.
SLOW = ("forward", "backward", "exhaustive", "stability", "boruta", "drop", "permutation")


@pytest.mark.parametrize("method", sorted(set(ranking.METHODS) - {"variance"}))
def test_methods(tables, method):
    for target, t in tables.items():
        if target == "z" and method in (*ranking.CLASSES_ONLY, *SLOW):
            continue
        got = {r["column"]: r["score"] for r in ranking.METHODS[method](t).collect()}
        assert set(got) == {"a", "noise", "colour", "word"}, (method, got)
        assert got["colour"] > max(got["noise"], got["word"]), (method, target, got)


def test_scores_are_summed_back(tables):
    t = tables["y"]
    x = t.rows.toPandas()
    want = dict.fromkeys(t.columns(), 0.0)
    for e, c in t.origin.items():
        per = [g[e].to_numpy() for _, g in x.groupby("label")]
        mean, n = x[e].mean(), len(x)
        want[c] += (sum(len(g) * (g.mean() - mean) ** 2 for g in per) / (len(per) - 1)) / (sum(((g - g.mean()) ** 2).sum() for g in per) / (n - len(per)))
    got = {r["column"]: r["score"] for r in ranking.METHODS["f"](t).collect()}
    assert set(got) == set(want) and all(np.isclose(got[c], want[c]) for c in want)
    spread = {r["column"]: r["score"] for r in ranking.METHODS["variance"](t).collect()}
    assert np.isclose(spread["colour"], 2 / 3) and np.isclose(spread["a"], x["e0"].var() / (x["e0"].max() - x["e0"].min()) ** 2)


def test_columns_needed_and_effects(spark, rows):
    points, n = api.columns_needed(rows.drop("day", "z"), "y", ["f"])
    assert [p["columns"] for p in points] == [1, 2, 3, 4] and n <= 2 and points[0]["score"] > 0.8
    df = rows.drop("day", "y").withColumn("id", F.monotonically_increasing_id())
    fitted = api.train(df, "z", "id", ["linear"], k=2)
    by_colour = {r["value"]: r["mean"] for r in api.effects(fitted, df, "colour").collect()}
    assert np.isclose(by_colour["green"] - by_colour["red"], 3, atol=0.05) and np.isclose(by_colour["blue"] - by_colour["green"], 3, atol=0.05)
    line = sorted((r["value"], r["mean"]) for r in api.effects(fitted, df, "a").collect())
    assert len(line) == 9 and np.isclose((line[-1][1] - line[0][1]) / (line[-1][0] - line[0][0]), 0.01, atol=1e-3)
