"""Exact quantiles and distinct counts of many columns at once, without a state that grows with a column's values."""

from __future__ import annotations

import bisect
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.sources.scratch import stored

#: Ranges that a column's values are cut into.
CUTS = 512


def unpivot(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(k, x): the number of a column in named, and its values, of one type, as rows; nulls are left out."""
    parts = [F.struct(F.lit(k).alias("k"), x.alias("x")) for k, x in enumerate(named.values())]
    return df.select(F.explode(F.array(*parts)).alias("r")).select("r.k", "r.x").where("x is not null")


def distinct_counts(df: DataFrame, named: dict[str, Column]) -> dict[str, int]:
    """How many distinct values each column has, null not counted: one shuffle of the distinct values of all of them."""
    if not named:
        return {}
    found = unpivot(df, {c: x.cast("string") for c, x in named.items()}).distinct().groupBy("k").count().collect()
    n = {r["k"]: r["count"] for r in found}
    return {c: n.get(k, 0) for k, c in enumerate(named)}


def _near(cuts: list[float], share: float) -> tuple[float, float]:
    """The values between which a quantile lies for certain enough: three cuts to either side of where it should be."""
    at = math.floor(share * (len(cuts) + 1))
    low, high = at - 3, at + 3
    return (cuts[low] if low >= 0 else -math.inf), (cuts[high] if high < len(cuts) else math.inf)


def exact_quantiles(df: DataFrame, named: dict[str, Column], shares: list[float]) -> dict[str, list[float] | None]:
    """Quantiles of numeric columns, interpolated between the two nearest values; None for a column without values.

    NaN and null count for nothing. Two passes over df: approximate quantiles of all columns, which cut each into CUTS
    ranges of about as many rows, whatever its values are; then the rows of each range are counted, and in ranges near a
    wanted quantile those of each value. Partial sums are combined before they move, so a value that most rows share is
    one row; the driver gets a count for each range. Should a quantile lie outside the ranges that were looked at, these
    are counted in a further pass.
    """
    if not named:
        return {}
    named = {c: F.nanvl(x.cast("double"), F.lit(None).cast("double")) for c, x in named.items()}
    flat = df.select(*[x.alias(f"x{k}") for k, x in enumerate(named.values())])
    rough = flat.agg(*[F.percentile_approx(f"x{k}", [j / CUTS for j in range(1, CUTS)], 20 * CUTS).alias(f"x{k}") for k in range(len(named))]).first()
    cuts = {k: rough[f"x{k}"] for k in range(len(named)) if rough[f"x{k}"]}
    if not cuts:
        return dict.fromkeys(named)
    splits = {k: [-math.inf, *sorted({v for v in q if abs(v) < math.inf}), math.inf] for k, q in cuts.items()}
    bucket = Bucketizer(splitsArray=list(splits.values()), inputCols=[f"x{k}" for k in splits], outputCols=[f"b{k}" for k in splits], handleInvalid="keep")
    parts = [F.struct(F.lit(k).alias("k"), F.col(f"b{k}").cast("int").alias("b"), F.col(f"x{k}").alias("x")) for k in splits]
    rows = bucket.transform(flat).select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("x is not null")
    looked: dict[int, set[int]] = {}
    for k, q in cuts.items():
        for share in shares:
            low, high = _near(q, share)
            place = lambda v, s=splits[k]: min(bisect.bisect_right(s, v) - 1, len(s) - 2)
            looked.setdefault(k, set()).update(range(place(low), place(high) + 1))
    codes = [k * 2 * CUTS + b for k, some in looked.items() for b in sorted(some)]
    shown = F.when((F.col("k") * 2 * CUTS + F.col("b")).isin(codes), F.col("x"))
    told = stored(rows.groupBy("k", "b", shown.alias("x")).agg(F.count("*").alias("n")), "quantiles")
    counts: dict[int, dict[int, int]] = {}
    for r in told.groupBy("k", "b").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["k"], {})[r["b"]] = r["n"]
    wanted: dict[tuple[int, int, int], None] = {}
    places: dict[tuple[int, int], tuple] = {}

    def locate(k: int, rank: int) -> tuple[int, int, int]:
        for b in sorted(counts[k]):
            if rank < counts[k][b]:
                return k, b, rank
            rank -= counts[k][b]
        raise ValueError("a rank beyond the rows; the table changed while it was read")

    for k in counts:
        n = sum(counts[k].values())
        for i, share in enumerate(shares):
            at = (n - 1) * share
            places[k, i] = locate(k, math.floor(at)), locate(k, math.ceil(at)), at % 1
            wanted |= dict.fromkeys(places[k, i][:2])
    spark = df.sparkSession
    ranks = F.broadcast(spark.createDataFrame(list(wanted), "k int, b int, rank long"))
    some = told
    missed = {(k, b) for k, b, _ in wanted if b not in looked[k]}
    if missed:
        held = F.broadcast(spark.createDataFrame(list(missed), "k int, b int"))
        some = told.join(held, ["k", "b"], "left_anti").unionByName(rows.join(held, ["k", "b"], "left_semi").groupBy("k", "b", "x").agg(F.count("*").alias("n")))
    some = some.join(ranks.select("k", "b").distinct(), ["k", "b"], "left_semi")
    some = some.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    hits = some.join(ranks, ["k", "b"]).where("rank < upto and rank >= upto - n").select("k", "b", "rank", "x").collect()
    value = {(r["k"], r["b"], r["rank"]): r["x"] for r in hits}

    def between(low: tuple, high: tuple, part: float) -> float:
        a, b = value[low], value[high]
        return a if a == b else a + (b - a) * part

    return {c: [between(*places[k, i]) for i in range(len(shares))] if k in counts else None for k, c in enumerate(named)}


def medians(df: DataFrame, named: dict[str, Column]) -> dict[str, float | None]:
    return {c: q[0] if q else None for c, q in exact_quantiles(df, named, [0.5]).items()}
