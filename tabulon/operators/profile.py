"""Profiling: column statistics, kinds, issues and leak checks, each as one or a few aggregations over all columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.values import NUMBER_MARKS, looks_like_id, number, number_or_null
from tabulon.operators.quantiles import distinct_counts, medians

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
TINY, HIGH_MISSING, HIGH_CARDINALITY, LEAK = 50, 0.5, 50, 0.98


def kind_of_type(dtype: str) -> str:
    if dtype in NUMERIC or dtype.startswith("decimal"):
        return "number"
    if dtype.startswith("timestamp") or dtype == "date":
        return "date"
    return "boolean" if dtype == "boolean" else "text"


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that they can be counted and compared."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])


def unbiased_skewness(c: Column) -> Column:
    """Skewness with the adjustment for sample size; null under three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def unpivoted(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One wide row with columns <column>__<field> as one row for each column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in columns])
    return row.select(F.explode(rows).alias("x")).select("x.*")


def numeric_profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Count, missing, distinct, mean, sample deviation, least, median, largest and skewness of columns.

    The moments are one aggregation over all columns; medians and distinct counts come from quantiles.py, whose state
    doesn't grow with a column's values. exact=False takes approximate ones in the same aggregation.
    """
    out = []
    # 0.0 and -0.0 are one value
    named = {c: number_or_null(F.col(f"`{c}`")) + 0.0 for c in columns}
    middles, distincts = (medians(df, named), distinct_counts(df, named)) if exact else ({}, {})
    for c, x in named.items():
        middle = F.lit(middles[c]).cast("double") if exact else F.percentile_approx(x, 0.5, 10_000).cast("double")
        distinct = F.lit(distincts[c]).cast("long") if exact else F.approx_count_distinct(x, 0.01)
        stats = {"n": F.count("*"), "n_missing": F.count("*") - F.count(x), "missing_share": 1 - F.try_divide(F.count(x), F.count("*")), "n_unique": distinct, "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "median": middle, "max": F.max(x), "skew": unbiased_skewness(x)}
        out += [v.alias(f"{c}__{k}") for k, v in stats.items()]
    return unpivoted(df.agg(*out), columns, ["n", "n_missing", "missing_share", "n_unique", "mean", "std", "min", "median", "max", "skew"])


def value_shares(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """(column, value, n, share): how often each value stands in each column; the top most frequent, ties by value.

    One scan: columns are unpivoted before a single aggregation. Shares are of the values that aren't null.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    out = counts.join(F.broadcast(total), "column").select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"))
    if top is None:
        return out
    best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", "n", "share")))
    # keep the best of each half-aggregated slice, so no group is gathered whole
    sliced = out.groupBy("column", F.pmod(F.xxhash64("value"), F.lit(64)).alias("slice")).agg(F.slice(best, 1, top).alias("some"))
    merged = sliced.select("column", F.explode("some").alias("x")).groupBy("column").agg(F.slice(F.sort_array(F.collect_list("x")), 1, top).alias("some"))
    return merged.select("column", F.explode("some").alias("x")).select("column", "x.value", "x.n", "x.share")


def imbalance(df: DataFrame, column: str) -> DataFrame:
    """n, n_classes, minority_share, ratio and imbalanced of a target: one row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("n_classes"), F.min("c").alias("low"), F.max("c").alias("high"))
    share, ratio = F.col("low") / F.col("n"), F.col("high") / F.col("low")
    return row.select("n", "n_classes", share.alias("minority_share"), ratio.alias("ratio"), ((F.col("n_classes") > 1) & ((share < 0.2) & (ratio > 3) | (ratio > 10))).alias("imbalanced"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows and n_duplicates: rows equal to another but one of each."""
    flat = flattened(df)
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def dependencies(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, n_values, most_targets, determines): whether each value of a column goes with one value of the target."""
    long = df.select(F.col(target).cast("string").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("y", "x.*").distinct()
    per = long.where("value is not null").groupBy("column", "value").agg(F.count("y").alias("t"))
    return per.groupBy("column").agg(F.count("*").alias("n_values"), F.max("t").alias("most_targets")).withColumn("determines", F.col("most_targets") == 1)


def target_links(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, identical, corr, leak): columns that equal a numeric target or follow it almost perfectly."""
    y = F.col(target).cast("double")
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        out += [F.bool_and(F.col(c).cast("string").eqNullSafe(F.col(target).cast("string"))).alias(f"{c}__identical"), F.corr(x, y).alias(f"{c}__corr")]
    rows = unpivoted(df.agg(*out), columns, ["identical", "corr"])
    return rows.withColumn("leak", F.col("identical") | (F.abs("corr") >= LEAK))


@dataclass
class ColumnKind:
    """What a column is: numeric, categorical, datetime, text, id, constant or empty."""

    name: str
    kind: str
    dtype: str
    n_missing: int
    n_unique: int
    note: str = ""
    stored_as_text: bool = False
    stats: dict = field(default_factory=dict)


def infer_kinds(df: DataFrame, order: str | None = None, date_formats: bool = True) -> list[ColumnKind]:
    """The kind of every column, from one wide aggregation over all rows, and medians and distinct counts of all columns.

    order: a column by which rows are numbered; a numeric column that counts 0, 1, 2 … or 1, 2, 3 … is an id if all values
    are distinct, whole and span as many numbers as there are, which needs no row order.
    """
    df = flattened(df)
    total = F.count("*").alias("rows")
    wanted, distinct, middle = [total], {}, {}
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if kind_of_type(t) == "number":
            x = number_or_null(x)
        q = F.trim(x.cast("string"))
        some = F.nullif(q, F.lit("")) if t == "string" else q
        wanted.append(F.count(x).alias(f"{c}__n"))
        distinct[c] = x
        as_number = x if kind_of_type(t) == "number" else number(x) if t == "string" else None
        if as_number is not None:
            wanted += [
                F.try_divide(F.count(as_number), F.count(x)).alias(f"{c}__numeric"),
                F.coalesce(F.bool_or(q.rlike(r"^0\d+$")) if t == "string" else F.lit(False), F.lit(False)).alias(f"{c}__zeros"),
                F.coalesce(F.bool_and(as_number == F.floor(as_number)), F.lit(False)).alias(f"{c}__whole"),
                F.min(as_number).alias(f"{c}__min"), F.max(as_number).alias(f"{c}__max"), F.avg(as_number).alias(f"{c}__mean"), F.stddev_samp(as_number).alias(f"{c}__std"),
            ]
            middle[f"{c}__median"] = as_number
        if t == "string":
            wanted += [
                F.try_divide(F.count(F.when(some.rlike(r"\d"), 1)), F.count(x)).alias(f"{c}__digit"),
                F.try_divide(F.count(F.when(F.regexp_replace(some, NUMBER_MARKS, "").rlike(r"^-?\d+(\.\d+)?$"), 1)), F.count(x)).alias(f"{c}__plain"),
                F.avg(F.size(F.split(q, r"\s+"))).alias(f"{c}__words"),
            ]
            middle[f"{c}__length"] = F.length(some)
    row = df.agg(*wanted).first().asDict() | medians(df, middle) | {f"{c}__u": n for c, n in distinct_counts(df, distinct).items()}
    out = []
    for c, t in df.dtypes:
        get = lambda k: row[f"{c}__{k}"]  # noqa: B023, E731
        n, u = get("n"), get("u")
        info = ColumnKind(c, "", t, row["rows"] - n, u)
        ratio = u / n if n else 0.0
        base = kind_of_type(t)
        if not n:
            info.kind = "empty"
        elif u <= 1:
            info.kind = "constant"
        elif base == "date":
            info.kind = "datetime"
        elif base == "boolean":
            info.kind = "categorical"
        elif (base == "number" or get("numeric") >= 0.95) and not get("zeros"):
            info.stored_as_text = base == "text"
            counter = get("whole") and u == n > 20 and get("min") in (0, 1) and get("max") - get("min") + 1 == n
            if counter or looks_like_id(c) and get("whole") and ratio >= 0.95:
                info.kind, info.note = "id", "counts rows" if counter else "an id by its name"
            else:
                info.kind = "numeric"
                info.stats = {k: get(k) for k in ("mean", "std", "min", "median", "max")}
        elif date_formats and get("digit") > 0.9 and get("plain") <= 0.5 and (get("length") or 0) >= 6 and _date_format(df, c):
            info.kind, info.note = "datetime", _date_format(df, c) or ""
        elif (get("words") or 0) >= 4 and ratio >= 0.5:
            info.kind = "text"
        elif ratio >= 0.95 and n >= 30 or looks_like_id(c) and ratio >= 0.8:
            info.kind = "id"
        else:
            info.kind = "categorical"
            info.note = f"{u} values" if u > HIGH_CARDINALITY else ""
        out.append(info)
    return out


def _date_format(df: DataFrame, column: str) -> str | None:
    from tabulon.functions.values import guess_date_format

    return guess_date_format(df.select(F.col(f"`{column}`").alias("x")), "x")


def kinds_frame(df: DataFrame) -> DataFrame:
    """infer_kinds() as a table."""
    rows = [(i.name, i.kind, i.n_missing, i.n_unique, i.stored_as_text) for i in infer_kinds(df)]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, n_missing long, n_unique long, stored_as_text boolean")


def issues(df: DataFrame, target: str | None = None) -> DataFrame:
    """(level, code, column, detail): what is worth knowing before a table is used."""
    kinds = infer_kinds(df)
    rows: list[tuple] = []
    counts = duplicate_rows(df).first()
    if counts["n_rows"] < TINY:
        rows.append(("warn", "tiny", None, float(counts["n_rows"])))
    if counts["n_duplicates"]:
        rows.append(("info", "duplicates", None, float(counts["n_duplicates"])))
    for i in kinds:
        share = i.n_missing / max(1, counts["n_rows"])
        if i.kind in ("id", "constant", "empty"):
            rows.append(("info", "dropped", i.name, float(i.n_unique)))
            continue
        if share >= HIGH_MISSING:
            rows.append(("warn", "missing", i.name, share))
        if i.stored_as_text:
            rows.append(("info", "numeric_text", i.name, float(i.n_unique)))
        if i.kind == "categorical" and i.n_unique > HIGH_CARDINALITY:
            rows.append(("info", "cardinality", i.name, float(i.n_unique)))
    if target:
        names = [i.name for i in kinds if i.kind == "numeric" and i.name != target]
        own = next(i for i in kinds if i.name == target)
        if own.kind == "numeric" and names:
            rows += [("warn", "leak", r["column"], r["corr"]) for r in target_links(df, names, target).where("leak").collect()]
        elif own.kind == "categorical":
            row = imbalance(df, target).first()
            if row["imbalanced"]:
                rows.append(("warn", "imbalance", target, row["minority_share"]))
            names = [i.name for i in kinds if i.kind == "categorical" and i.name != target]
            if names:
                rows += [("warn", "leak", r["column"], float(r["n_values"])) for r in dependencies(df, names, target).where("determines and n_values > 1").collect()]
    return df.sparkSession.createDataFrame(rows, "level string, code string, column string, detail double")


def redacted(profile: DataFrame) -> DataFrame:
    """A profile without examples of values."""
    return profile.drop(*[c for c in ("value", "examples", "top") if c in profile.columns])
