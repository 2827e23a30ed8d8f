"""Exact nearest neighbours over whole tables: a join partitioned by pivots, whose bounds say which cells a row has to visit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.sources.scratch import stored

#: Distinct points that a cell is meant to hold, the most pivots, and queries that meet a cell in one task.
CELL, PIVOTS, CHUNK = 1000, 4096, 8192
#: Numbers in a table of distances: a task takes as many rows at once as fit, so its memory doesn't grow with pivots or cells.
BLOCK = 1 << 18
_FOUND = "key long, near array<struct<d: double, key: long>>"


def point(columns: list[str]) -> Column:
    """Columns as an array of doubles; what isn't a finite number is 0."""
    return F.array(*[F.when(F.abs(x := F.col(c).cast("double")) < float("inf"), x).otherwise(0.0) for c in columns])


def standardised(df: DataFrame, columns: list[str]) -> Column:
    """point(), with each column's mean 0 and spread 1 over all of df."""
    x = {c: F.when(F.abs(v := F.col(c).cast("double")) < float("inf"), v).otherwise(0.0) for c in columns}
    seen = df.agg(*[f(v).alias(f"{n}_{k}") for k, v in enumerate(x.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return F.array(*[(v - F.lit(seen[f"m_{k}"] or 0.0)) / F.lit(seen[f"s_{k}"] or 1.0) for k, v in enumerate(x.values())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _at_once(columns: int, most: int) -> int:
    return int(np.clip(BLOCK // max(1, columns), 1, most))


def _lists(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Arrays of distances and keys as an Arrow column of lists of both."""
    ends = np.concatenate([[0], np.cumsum([len(d) for d, _ in found])]).astype(np.int32)
    d, e = (np.concatenate([*[x[k] for x in found], np.empty(0, t)]).astype(t) for k, t in enumerate((np.float64, np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d), pa.array(e)], ["d", "key"]))


def _closest(q: np.ndarray, own: np.ndarray, reach: np.ndarray, p: np.ndarray, keys: np.ndarray, k: int, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the distances and keys of up to k points within its reach, the nearest first, ties by key."""
    scale = float((p**2).sum(1).max()) if len(p) else 0.0
    some = _at_once(len(p), 256)
    for low in range(0, len(q), some):
        part = q[low : low + some]
        d = _squares(part, p)
        if apart:
            d[own[low : low + some, None] == keys[None]] = np.inf
        slack = 1e-9 * (scale + (part**2).sum(1) + 1)  # products lose digits: candidates are measured anew
        most = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1] if len(p) > k else np.inf, reach[low : low + some] ** 2) + slack
        for row, limit, x, far in zip(d, most, part, reach[low : low + some], strict=True):
            at = np.flatnonzero(row <= limit)
            exact = np.sqrt(((p[at] - x) ** 2).sum(1))
            if apart:
                fine = row[at] < np.inf
                at, exact = at[fine], exact[fine]
            order = np.lexsort((keys[at], exact))[:k]
            order = order[exact[order] <= far * (1 + 1e-9) + 1e-12]
            yield exact[order], keys[at[order]]


class Cells:
    """Distinct points by their nearest pivot, with what bounds need: pivots, and each cell's number of points and radius."""

    def __init__(self, points: DataFrame, width: int, per_cell: int | None = None, seed: int = 42) -> None:
        """points: key (a long, unique) and x; rows with the same x are expected once."""
        n = points.count()
        some = points.select("x").orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(max(1, min(PIVOTS, n // (per_cell or CELL)))).collect()
        self.width, self.pivots = width, np.array([r["x"] for r in some], float).reshape(len(some), width)
        self.points = stored(self._assigned(points), "cells")
        self.radius, self.count = np.full(len(some), -np.inf), np.zeros(len(some), np.int64)
        for r in self.points.groupBy("cell").agg(F.max("to").alias("r"), F.count("*").alias("n")).collect():  # a row a pivot
            self.radius[r["cell"]], self.count[r["cell"]] = r["r"], r["n"]

    def _assigned(self, rows: DataFrame) -> DataFrame:
        pivots, width = self.pivots, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = _at_once(len(pivots), 4096)
                for low in range(0, len(batch), some):
                    part = batch.slice(low, some)
                    x = _matrix(part.column(1), width)
                    cell = _squares(x, pivots).argmin(1) if len(x) else np.zeros(0, np.int64)
                    to = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(to)], names=["key", "x", "cell", "to"])

        return rows.select("key", "x").mapInArrow(run, "key long, x array<double>, cell int, to double")

    def _meet(self, queries: DataFrame, k: int, apart: bool) -> DataFrame:
        """Up to k nearest points of one cell for each query (key, x, reach, cell). Cells that many queries visit are met in chunks."""
        visits = queries.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        # a row a pivot
        chunked = queries.join(F.broadcast(visits), "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
        points = self.points.join(F.broadcast(visits), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "key", "x")
        width = self.width

        def run(which: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            p, keys = _matrix(right.column("x"), width), right.column("key").to_numpy()
            own = left.column("key").to_numpy()
            found = list(_closest(_matrix(left.column("x"), width), own, left.column("reach").to_numpy(), p, keys, k, apart)) if len(p) and len(own) else []
            return pa.table({"key": pa.array(own[: len(found)], pa.int64()), "near": _lists(found)})

        return chunked.select("cell", "chunk", "key", "x", "reach").groupBy("cell", "chunk").cogroup(points.groupBy("cell", "chunk")).applyInArrow(run, _FOUND)

    def nearest(self, queries: DataFrame, k: int, apart: bool = False) -> DataFrame:
        """(key, near): the k nearest points (d, key) of each query (key, x), ties by key; apart: not itself.

        A query first meets its own cell. The distance of the k-th point there, or what the cells' radii and numbers
        promise, is a bound; the query then visits only cells that reach into it, past the plane between both pivots.
        """
        pivots, width, radius, count, need = self.pivots, self.width, self.radius, self.count, k + apart
        between = np.sqrt(_squares(pivots, pivots))
        first = self._assigned(queries).withColumn("reach", F.lit(float("inf")))
        home = stored(self._meet(first.select("cell", "key", "x", "reach"), k, apart), "home")
        bound = home.select("key", F.when(F.size("near") == k, F.element_at("near", -1)["d"]).otherwise(float("inf")).alias("reach"))
        rows = first.select("key", "x", "cell").join(bound.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"), "left")

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = _at_once(len(pivots), 1024)
                for low in range(0, len(batch), some):
                    part = batch.slice(low, some)
                    if not len(part):
                        continue
                    x, cell = _matrix(part.column(1), width), part.column(2).to_numpy()
                    reach = part.column(3).fill_null(float("inf")).to_numpy(zero_copy_only=False)
                    d = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2)) if len(pivots) * width <= 4096 else np.sqrt(_squares(x, pivots))
                    # so many points are certainly within the far end of a cell
                    far = np.where(count > 0, d + radius, np.inf)
                    order = np.argsort(far, axis=1)
                    enough = np.cumsum(count[order], 1) >= need
                    sure = np.where(enough.any(1), np.take_along_axis(far, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], np.inf)
                    reach = np.minimum(reach, sure)
                    slack = 1e-6 * (1 + np.abs(x).max(1) + np.abs(pivots).max())
                    limit = (reach + slack)[:, None]
                    own = np.take_along_axis(d, cell[:, None], 1)
                    gap = between[cell]
                    plane = (d**2 - own**2) / np.where(gap > 0, 2 * gap, 1)
                    hit = (count > 0) & (d - radius <= limit) & (plane <= limit)
                    hit[np.arange(len(x)), cell] = False
                    row, to = np.nonzero(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(reach[row])], names=["cell", "key", "x", "reach"])

        away = self._meet(rows.select("key", "x", "cell", "reach").mapInArrow(visit, "cell int, key long, x array<double>, reach double"), k, apart)
        # a query's cells have k points each at most, and only those within its bound
        return home.unionByName(away).groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """Distinct points of rows (id, x): x, ids (the most smallest), key (the smallest); large groups are cut before they move."""
    w = Window.partitionBy("x").orderBy("id")
    some = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    return some.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.col("ids")[0])


def nearest_rows(df: DataFrame, row_id: str, x: Column, width: int, k: int, points: DataFrame | None = None, per_cell: int | None = None) -> DataFrame:
    """(row_id, near): for each row of df the k nearest others, as an array of (d, id), ties by id.

    row_id: unique longs. x: an array of width doubles without nulls or NaN. points (id, x): those to search in, other than
    df's own rows. Rows with the same x are one point: it is searched for once, and however many they are, the k + 1
    smallest ids stand for them. No row is left out and none is sampled; a row's own cell and those that its k-th distance
    reaches into are all that it meets. Tables of one row have no neighbours (an empty array); without rows, the result is
    empty.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id"), x.alias("x"))
    apart = points is None
    own = stored(_distinct(rows, k + 1), "distinct")
    among = own if apart else stored(_distinct(points.select(F.col("id").cast("long").alias("id"), "x"), k + 1), "among")
    cells = Cells(among.select("key", "x"), width, per_cell)
    found = cells.nearest(own.select("key", "x"), k, apart)
    each = found.select("key", F.explode("near").alias("n")).select("key", F.col("n.d").alias("d"), F.col("n.key").alias("__n"))
    named = each.join(among.select(F.col("key").alias("__n"), "ids"), "__n").select("key", F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("near"))
    if apart:
        named = named.unionByName(own.select("key", F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id"))).alias("near")))
    lists = named.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + apart).alias("near"))
    by_point = own.select("x", "key").join(lists, "key", "left").select("x", F.coalesce("near", F.expr("cast(array() as array<struct<d: double, id: bigint>>)")).alias("near"))
    out = rows.join(by_point.withColumnRenamed("x", "__x"), F.col("x") == F.col("__x"))
    near = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k) if apart else F.col("near")
    return out.select(F.col("id").alias(row_id), near.alias("near"))


class Nearest:
    """A model of the k nearest training rows, weighted by closeness; k grows with the root of their number.

    All training rows are kept, as a table, and searched exactly. Rows to be predicted that have the same features are one
    query. A prediction is a weighted mean of numbers, or of class shares (probability); far from all rows it is their mean.
    """

    def __init__(self, classes: int) -> None:
        self.classes, self.k, self.width = classes, 0, 0
        self.points: DataFrame | None = None

    def fit(self, df: DataFrame) -> Nearest:
        rows = df.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        self.points = stored(rows, "nearest")
        about = self.points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).first()
        self.k, self.width = int(np.clip(round(np.sqrt(about["n"]) / 4), 3, 15)), about["w"] or 0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        asked = stored(df.select(vector_to_array("features").alias("x")).distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
        near = nearest_rows(asked, "id", F.col("x"), self.width, self.k, points=self.points)
        pairs = near.select("id", F.explode("near").alias("n")).select("id", (1 / F.greatest(F.col("n.d"), F.lit(1e-9))).alias("w"), F.col("n.id").alias("other"))
        pairs = pairs.join(self.points.select(F.col("id").alias("other"), "label"), "other")
        total = F.sum("w")
        shares = [F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)) / total for c in range(self.classes)] or [F.sum(F.col("w") * F.col("label")) / total]
        told = asked.join(pairs.groupBy("id").agg(F.array(*shares).alias("__p")), "id").select(F.col("x").alias("__x"), "__p")
        out = df.withColumn("__f", vector_to_array("features")).join(told, F.col("__f") == F.col("__x")).drop("__f", "__x")
        if not self.classes:
            return out.withColumn("prediction", F.col("__p")[0]).drop("__p")
        best = F.array_position("__p", F.array_max("__p")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("__p")).drop("__p")

    def save(self, path: str) -> dict:
        """Write the training rows to path; what JSON holds besides."""
        self.points.write.mode("overwrite").parquet(path)
        return {"classes": self.classes, "k": self.k, "width": self.width}

    @classmethod
    def restored(cls, state: dict, path: str) -> Nearest:
        out = cls(state["classes"])
        out.k, out.width = state["k"], state["width"]
        out.points = SparkSession.active().read.schema("id long, x array<double>, label double").parquet(path)
        return out
