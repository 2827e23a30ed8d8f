"""Drift: distributions of a reference table and of new data compared column by column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.quantiles import exact_quantiles

MODERATE, MAJOR, SMALLEST, TOP = 0.1, 0.25, 1e-4, 50


def psi(expected: str, actual: str, by: list[str], rows: DataFrame) -> DataFrame:
    """Population stability index of two share columns over the bins in rows, for each by; shares under 1e-4 count as that and are scaled to 1 again."""
    floor = rows.withColumns({"_e": F.greatest(F.col(expected), F.lit(SMALLEST)), "_a": F.greatest(F.col(actual), F.lit(SMALLEST))})
    total = floor.groupBy(*by).agg(F.sum("_e").alias("_te"), F.sum("_a").alias("_ta"))
    # sum((a/ta - e/te) * ln((a/ta) / (e/te)))
    e, a = F.col("_e") / F.col("_te"), F.col("_a") / F.col("_ta")
    return floor.join(F.broadcast(total), by).groupBy(*by).agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def two_way_psi(before: Column, now: Column) -> Column:
    """Index of a share and its rest."""
    low = lambda x: F.greatest(x, F.lit(SMALLEST))
    e0, e1, a0, a1 = low(1 - before), low(before), low(1 - now), low(now)
    e, a = e0 + e1, a0 + a1
    term = lambda x, y: (y / a - x / e) * F.ln((y / a) / (x / e))
    return term(e0, a0) + term(e1, a1)


def edges(reference: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Distinct deciles of each numeric column of the reference."""
    tenths = exact_quantiles(reference, {c: F.col(f"`{c}`") for c in columns}, [k / 10 for k in range(1, 10)])
    return {c: sorted(set(q)) for c, q in tenths.items() if q}


def bin_of(x: Column, cuts: list[float]) -> Column:
    """How many cuts are at most x: bins that are closed on the left."""
    out = F.lit(0)
    for c in cuts:
        out = out + (x >= F.lit(c)).cast("int")
    return out


def _bins(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), bin_of(F.col(c).cast("double"), e).alias("bin")) for c, e in cuts.items()])
    return df.select(F.explode(rows).alias("r")).select("r.*").where("x is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))


def numeric_drift(reference: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(column, psi, outside, shift, mean_before, mean_now, missing_before, missing_now, status) of numeric columns."""
    cuts = edges(reference, columns)
    spark = reference.sparkSession
    bins = spark.createDataFrame([(c, b) for c, e in cuts.items() for b in range(len(e) + 1)], "column string, bin int")
    count = lambda df, n: bins.join(_bins(df, cuts).withColumnRenamed("n", n), ["column", "bin"], "left").na.fill(0, [n])
    both = count(reference, "n1").join(count(new, "n2"), ["column", "bin"])
    total = both.groupBy("column").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    both = both.join(F.broadcast(total), "column").withColumns({"e": F.col("n1") / F.col("t1"), "a": F.col("n2") / F.col("t2")})
    index = psi("e", "a", ["column"], both)

    def summary(df: DataFrame, tag: str) -> DataFrame:
        parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cuts]
        long = df.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
        return long.groupBy("column").agg(F.avg("x").alias(f"mean_{tag}"), F.min("x").alias(f"min_{tag}"), F.max("x").alias(f"max_{tag}"), (1 - F.count("x") / F.count("*")).alias(f"missing_{tag}"))

    known = summary(reference, "before")
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cuts]
    long = new.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("x is not null")
    outside = long.join(F.broadcast(known), "column").groupBy("column").agg(F.avg(((F.col("x") < F.col("min_before")) | (F.col("x") > F.col("max_before"))).cast("double")).alias("outside"))
    table = index.join(known, "column").join(summary(new, "now"), "column").join(outside, "column")
    shift = (F.col("mean_now") - F.col("mean_before")) / F.greatest(F.col("max_before") - F.col("min_before"), F.lit(1e-12))
    table = table.withColumn("psi", F.greatest("psi", two_way_psi(F.col("missing_before"), F.col("missing_now")))).withColumn("shift", shift)
    return table.select("column", "psi", "outside", "shift", "mean_before", "mean_now", "missing_before", "missing_now", status(F.col("psi"), F.col("outside")).alias("status"))


def status(index: Column, outside: Column) -> Column:
    high = lambda p, o: (F.coalesce(index, F.lit(0.0)) > p) | (F.coalesce(outside, F.lit(0.0)) > o)
    return F.when(high(MAJOR, 0.2), "major").when(high(MODERATE, 0.05), "moderate").otherwise("stable")


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns]
    counts = df.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total), "column").select("column", "value", (F.col("n") / F.col("t")).alias("share"), "n")


def known_shares(reference: DataFrame, columns: list[str], top: int = TOP) -> DataFrame:
    """(column, value, share) of the top categories (ties by value), and the share of all others under a null value."""
    all_ = shares(reference, columns)
    rank = F.row_number().over(_by("column").orderBy(F.desc("n"), "value"))
    ranked = all_.withColumn("k", rank).where(F.col("k") <= top).select("column", "value", "share")
    rest = ranked.groupBy("column").agg(F.greatest(F.lit(0.0), 1 - F.sum("share")).alias("share")).select("column", F.lit(None).cast("string").alias("value"), "share")
    return ranked.unionByName(rest)


def _by(*names: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*names)


def category_drift(reference: DataFrame, new: DataFrame, columns: list[str], top: int = TOP) -> DataFrame:
    """(column, psi, outside, status): outside is the share of values that the reference lacks, where its others are under 1%."""
    known = known_shares(reference, columns, top).withColumnRenamed("share", "e")
    now = shares(new, columns).select("column", "value", F.col("share").alias("a"))
    listed = known.where("value is not null")
    matched = listed.join(now, ["column", "value"], "left").select("column", "value", "e", F.coalesce("a", F.lit(0.0)).alias("a"))
    unseen = now.join(listed, ["column", "value"], "left_anti").groupBy("column").agg(F.sum("a").alias("a"))
    other = known.where("value is null").select("column", "e").join(unseen, "column", "left").select("column", F.lit(None).cast("string").alias("value"), "e", F.coalesce("a", F.lit(0.0)).alias("a"))
    table = psi("e", "a", ["column"], matched.unionByName(other))
    outside = other.select("column", F.when(F.col("e") < 0.01, F.col("a")).otherwise(0.0).alias("outside"))
    return table.join(outside, "column").select("column", "psi", "outside", status(F.col("psi"), F.col("outside")).alias("status"))


def new_values(reference: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, share) of values that only the new data have."""
    return shares(new, columns).select("column", "value", "share").join(shares(reference, columns).select("column", "value"), ["column", "value"], "left_anti")


def date_drift(reference: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(column, outside, latest_now): dates outside the reference's range."""
    span = reference.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return new.where(F.col(column).isNotNull()).join(F.broadcast(span)).agg(F.lit(column).alias("column"), F.avg(((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).cast("double")).alias("outside"), F.max(column).alias("latest_now"))


def ordered(table: DataFrame, importance: dict[str, float] | None = None) -> DataFrame:
    """Worst first: by status, then importance, then index."""
    weights = F.lit(0.0)
    for c, w in (importance or {}).items():
        weights = F.when(F.col("column") == c, F.lit(float(w))).otherwise(weights)
    place = F.when(F.col("status") == "missing", 0).when(F.col("status") == "major", 1).when(F.col("status") == "moderate", 2).otherwise(3)
    return table.withColumn("importance", weights).orderBy(place, F.desc("importance"), F.desc(F.coalesce("psi", F.lit(0.0))))


def verdict(table: DataFrame, weighted: bool = False) -> DataFrame:
    """One row: stable, moderate or major. With importances, a major column counts as such from an importance of 0.05."""
    matters = F.col("importance") >= 0.05 if weighted else F.lit(True)
    changed = F.col("status") != "stable"
    major = F.coalesce(F.bool_or((F.col("status") == "missing") | (F.col("status") == "major") & matters), F.lit(False))
    some = F.coalesce(F.bool_or(changed & matters | (F.col("status") == "major")), F.lit(False))
    return table.agg(F.when(major, "major").when(some, "moderate").otherwise("stable").alias("verdict"), F.count(F.when(changed, 1)).alias("n_changed"))


def summarise(df: DataFrame, numeric: list[str], categories: list[str]) -> dict:
    """What is kept of a table to compare later ones with: for numbers deciles, shares between them, range, mean and
    missing share; for categories the shares of the top values and of all others. Its size doesn't grow with the rows.
    """
    cuts = edges(df, numeric)
    out: dict = {"numeric": {}, "categories": {}}
    if cuts:
        shares_of, about = _bin_shares(df, cuts), _ranges(df, list(cuts))
        out["numeric"] = {c: {"cuts": cuts[c], "shares": shares_of[c], **about[c]} for c in cuts}
    if categories:
        for r in known_shares(df, categories).collect():
            own = out["categories"].setdefault(r["column"], {"values": {}, "rest": 0.0})
            if r["value"] is None:
                own["rest"] = r["share"]
            else:
                own["values"][r["value"]] = r["share"]
    return out


def _bin_shares(df: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[float]]:
    counts = {c: [0] * (len(e) + 1) for c, e in cuts.items()}
    for r in _bins(df, cuts).collect():
        counts[r["column"]][r["bin"]] = r["n"]
    return {c: [v / max(1, sum(n)) for v in n] for c, n in counts.items()}


def _ranges(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    stats = {"low": F.min, "high": F.max, "mean": F.avg}
    row = df.agg(*[f(v).alias(f"{c}__{k}") for c, v in x.items() for k, f in stats.items()], *[(1 - F.try_divide(F.count(v), F.count("*"))).alias(f"{c}__missing") for c, v in x.items()]).first()
    return {c: {k: row[f"{c}__{k}"] for k in (*stats, "missing")} for c in columns}


def _index(expected: list[float], actual: list[float]) -> float:
    e, a = ([max(v, SMALLEST) for v in s] for s in (expected, actual))
    return sum((y / sum(a) - x / sum(e)) * math.log(y / sum(a) / (x / sum(e))) for x, y in zip(e, a, strict=True))


def against(summary: dict, new: DataFrame) -> DataFrame:
    """(column, psi, outside, status) of new data against a kept summary; columns that are gone have the status missing."""
    rows: list[tuple] = []
    have = {c: s for c, s in summary["numeric"].items() if c in new.columns}
    if have:
        now, about = _bin_shares(new, {c: s["cuts"] for c, s in have.items()}), _ranges(new, list(have))
        far = new.agg(*[F.avg((~F.col(f"`{c}`").cast("double").between(s["low"], s["high"])).cast("double")).alias(c) for c, s in have.items()]).first()
        for c, s in have.items():
            gaps = _index([1 - s["missing"], s["missing"]], [1 - (about[c]["missing"] or 0.0), about[c]["missing"] or 0.0])
            rows.append((c, max(_index(s["shares"], now[c]), gaps), far[c] or 0.0))
    words = [c for c in summary["categories"] if c in new.columns]
    if words:
        # values that the summary lacks count together, so no more rows than it has values reach the driver
        known = new.sparkSession.createDataFrame([(c, v) for c in words for v in summary["categories"][c]["values"]], "column string, value string").withColumn("known", F.lit(True))
        found = shares(new, words).join(F.broadcast(known), ["column", "value"], "left")
        part = {(r["column"], r["v"]): r["a"] for r in found.groupBy("column", F.when(F.col("known"), F.col("value")).alias("v")).agg(F.sum("share").alias("a")).collect()}
        for c in words:
            own = summary["categories"][c]
            new_share = part.get((c, None), 0.0)
            psi_ = _index([*own["values"].values(), own["rest"]], [*(part.get((c, v), 0.0) for v in own["values"]), new_share])
            rows.append((c, psi_, new_share if own["rest"] < 0.01 else 0.0))
    table = new.sparkSession.createDataFrame(rows, "column string, psi double, outside double").withColumn("status", status(F.col("psi"), F.col("outside")))
    gone = [(c, None, 1.0, "missing") for c in [*summary["numeric"], *summary["categories"]] if c not in new.columns]
    return table.unionByName(new.sparkSession.createDataFrame(gone, "column string, psi double, outside double, status string"))


def warning(reference: DataFrame, new: DataFrame, columns: list[str], least: int = 30) -> str | None:
    """A line for a prediction's output if the new data, of least rows or more, differ much."""
    if new.limit(least).count() < least:
        return None
    bad = [r["column"] for r in numeric_drift(reference, new, columns).where("status = 'major'").collect()]
    return f"these columns differ much from the training data: {', '.join(sorted(bad))}" if bad else None
