"""Splits, folds and samples: exact sizes, decided by a hash of the row's id, so that any run gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(row_id: str, seed: int) -> Column:
    """A row's place in a random order that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))))


def holdout(df: DataFrame, row_id: str, target: str | None = None, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: the first share of each class in random order; without a target, of all rows."""
    if target is None:
        # whole buckets of the hash order, and the first rows of the one in which the share ends
        bucket = F.conv(F.substring(place(row_id, seed), 1, 4), 16, 10).cast("int")
        counts = {r["b"]: r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()}
        left, last = int(sum(counts.values()) * share), -1
        for last in sorted(counts):
            if counts[last] > left:
                break
            left -= counts[last]
        else:
            return df.withColumn("is_test", F.lit(bool(counts)))
        some = df.where(bucket == last).select(F.col(row_id).alias("_id"), place(row_id, seed).alias("_h")).orderBy("_h", "_id").limit(left).select("_id").withColumn("_t", F.lit(True))
        return df.join(F.broadcast(some), df[row_id] == F.col("_id"), "left").withColumn("is_test", (bucket < last) | F.coalesce("_t", F.lit(False))).drop("_id", "_t")
    numbered, sizes = _numbered(df, row_id, target, seed)
    out = numbered.join(F.broadcast(sizes), F.col("_c").eqNullSafe(F.col("_class")))
    return out.select(*df.columns, (F.col("_k") <= F.floor(F.col("_size") * share)).alias("is_test"))


def _numbered(df: DataFrame, row_id: str, target: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(df with _c, its class, and _k, its place from 1 in the class's random order; the classes' sizes).

    A class is numbered in 256 slices of the hash order, each after the counts of those before, so that no task holds
    a whole class. Classes are far fewer than rows: their sizes and slices are broadcast.
    """
    order = place(row_id, seed)
    slice_ = F.conv(F.substring(order, 1, 2), 16, 10).cast("int")
    rows = df.withColumns({"_c": F.col(target), "_s": slice_, "_o": order})
    counts = rows.groupBy("_c", "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_c").orderBy("_s")
    before = counts.select(F.col("_c").alias("_bc"), F.col("_s").alias("_bs"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    sizes = counts.groupBy(F.col("_c").alias("_class")).agg(F.sum("_n").alias("_size"))
    joined = rows.join(F.broadcast(before), F.col("_c").eqNullSafe(F.col("_bc")) & (F.col("_s") == F.col("_bs")))
    return joined.withColumn("_k", F.row_number().over(Window.partitionBy("_c", "_s").orderBy("_o")) + F.col("_before")), sizes


def folds(df: DataFrame, row_id: str, k: int = 5, target: str | None = None, seed: int = 42) -> DataFrame:
    """df with fold, 0 to k - 1: of nearly equal size in each class; k falls to the rarest class's size.

    Without a target a fold is the hash modulo k, which needs no shuffle and is even up to chance.
    """
    if target is None:
        return df.withColumn("fold", F.pmod(F.conv(F.substring(place(row_id, seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))
    rarest = df.groupBy(target).count().agg(F.min("count")).first()[0] or 1
    k = max(2, min(k, rarest))
    return _numbered(df, row_id, target, seed)[0].select(*df.columns, ((F.col("_k") - 1) % k).cast("int").alias("fold"))


def sample(df: DataFrame, size: float, row_id: str | None = None, seed: int = 42) -> DataFrame:
    """size rows, or that share of them if below 1; exact sizes take the first in random order."""
    if 0 < size < 1:
        return df.sample(False, size, seed)
    order = place(row_id, seed) if row_id else F.xxhash64(*df.columns, F.lit(seed))
    return df.withColumn("_h", order).orderBy("_h").limit(int(size)).drop("_h")


def half_samples(df: DataFrame, row_id: str, rounds: int, seed: int = 42) -> DataFrame:
    """Each row once for each round whose half it is in, with round."""
    hits = F.array(*[F.when(F.conv(F.substring(place(row_id, seed + k), 1, 1), 16, 10).cast("int") < 8, F.lit(k)) for k in range(rounds)])
    return df.withColumn("round", F.explode(F.array_compact(hits)))


def backtest_folds(df: DataFrame, ts: str, group: list[str], horizon: int, count: int) -> DataFrame:
    """df with steps_back (1 is the newest) and fold: of the last count * horizon periods, 0 the newest; null before."""
    w = Window.partitionBy(*group).orderBy(F.desc(ts))
    back = df.withColumn("steps_back", F.row_number().over(w))
    return back.withColumn("fold", F.when(F.col("steps_back") <= count * horizon, F.floor((F.col("steps_back") - 1) / horizon).cast("int")))
