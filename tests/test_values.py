"""Column functions, kinds and tasks on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabulon.functions import values
from tabulon.operators import profile, train


def one(spark, rows, f, kind="string"):
    return [r["y"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, x {kind}").select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_numbers(spark):
    assert one(spark, ["£2,050", "(7.5)", "12 %", "soon", " 0.25", None, "¥ 9"], values.number) == [2050, -7.5, 12, None, 0.25, None, 9]


def test_placeholders(spark):
    assert one(spark, ["NULL ", "--", " pear", "", "Unknown", "00"], values.cleaned_text) == [None, None, "pear", None, None, "00"]


def test_categories(spark):
    assert one(spark, [42.0, 0.75, None], lambda c: values.category(c, "double"), "double") == ["42", "0.75", None]
    assert one(spark, [True, False], lambda c: values.category(c, "boolean"), "boolean") == ["True", "False"]
    assert one(spark, ["8.00", " 8 ", "v8.0"], values.category_number_text) == ["8", "8", "v8.0"]


@pytest.mark.parametrize(("texts", "first"), [(["25/12/2019", "06/07/2019"], datetime.datetime(2019, 12, 25)), (["03/09/2022", "11/10/2022"], datetime.datetime(2022, 3, 9)), (["2021-07-30", "2021-08-02"], datetime.datetime(2021, 7, 30))])
def test_dates(spark, texts, first):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    fmt = values.guess_date_format(df, "x")
    assert df.select(values.date(F.col("x"), fmt).alias("y")).first()["y"] == first


def test_no_date(spark):
    assert values.guess_date_format(spark.createDataFrame([("later",), ("2020-10-10",)], "x string"), "x") is None


@pytest.mark.parametrize(("rows", "kind"), [
    ([0.25, 8.5, None, 13.0] * 12, "numeric"), (["€3,100", "€47", "€812", "€5"] * 6, "numeric"), (["5%", "61%", None, "33%"], "numeric"),
    (["0471", "0032", "7719", "0906"], "categorical"), (["oak", "elm", "ash"] * 5, "categorical"), ([f"2022-03-{d:02d}" for d in range(2, 31)], "datetime"),
    ([f"{d:02d}/11/2021" for d in range(13, 31)], "datetime"), ([f"parcel {k} left the depot late" for k in range(35)], "text"), ([f"k{k:03d}-z{k * 7}" for k in range(45)], "id"),
    ([3.5] * 9, "constant"), ([None] * 6, "empty"), (list(range(30)), "id"), (list(range(1, 41)), "id"), (list(range(1900, 1999, 3)), "numeric"), ([False, True, True] * 6, "categorical"),
])
def test_kinds(spark, rows, kind):
    kind_of = {bool: "boolean", int: "long", float: "double"}
    first = next((r for r in rows if r is not None), "")
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind_of.get(type(first), 'string')}")
    assert profile.infer_kinds(df)[0].kind == kind


def test_names():
    assert all(values.looks_like_id(n) for n in ("uuid", "orderId", "guid.main", "INVOICE NO", "session_key", "Unnamed: 3", "row id", "rowid", "Id-of-case"))
    assert not any(values.looks_like_id(n) for n in ("valid", "idle_time", "keynote", "no_show", "number", ""))
    assert values.resolve("Unit Price", ["unitprice", "units"]) == "unitprice"
    with pytest.raises(values.ColumnError, match="weight"):
        values.resolve("wieght", ["weight", "height"])


def test_parsers():
    assert values.parse_share("2%") == 0.02 and values.parse_share("auto") is None
    assert list(values.parse_range("2-4")) == [2, 3, 4] and list(values.parse_range("5")) == [5]
    assert values.parse_seconds("1h30m") == 5400 and values.show_seconds(75) == "1m 15s"
    for bad in (lambda: values.parse_share("0.7"), lambda: values.parse_share("x"), lambda: values.parse_range("8-2"), lambda: values.parse_seconds("abc")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("rows", "kind", "task"), [([1, 2, 3, 4, 5] * 4, "long", "classification"), ([1.5, 2.5, 3.1] * 9, "double", "regression"), (["a", "b"] * 5, "string", "classification"), ([str(k) for k in range(30)], "string", "regression"), ([0.5, 1.5] * 8, "double", "classification")])
def test_tasks(spark, rows, kind, task):
    assert train.infer_task(spark.createDataFrame([(r,) for r in rows], f"y {kind}"), "y") == task
