"""Groups of similar rows: finding, judging and describing them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.neighbours import nearest_rows, point
from tabulon.sources.scratch import stored


def relabelled(df: DataFrame, label: str = "prediction", name: str = "cluster") -> DataFrame:
    """df with cluster 0, 1, … from the largest group to the smallest (ties by label); negative labels are noise, -1."""
    sizes = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("_n"))
    w = Window.orderBy(F.desc("_n"), label)
    order = sizes.select(F.col(label).alias("_l"), (F.row_number().over(w) - 1).alias("_c"))
    return df.join(F.broadcast(order), F.col(label) == F.col("_l"), "left").withColumn(name, F.coalesce("_c", F.lit(-1))).drop("_c", "_l")


def kmeans(df: DataFrame, k: int, features: str = "features", starts: int = 10, seed: int = 42):  # noqa: ANN201
    """The best of several starts by training cost."""
    models = [KMeans(k=k, seed=seed + s, featuresCol=features).fit(df) for s in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def fit(df: DataFrame, algorithm: str, k: int, features: str = "features", seed: int = 42, starts: int = 3):  # noqa: ANN201
    """kmeans, gmm, or bisecting, which stands in for agglomerative clustering."""
    if algorithm == "kmeans":
        return kmeans(df, k, features, starts, seed)
    made = {"gmm": GaussianMixture, "bisecting": BisectingKMeans}[algorithm]
    return made(k=k, seed=seed, featuresCol=features).fit(df)


def centroids(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def separation(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin, from centroids and two aggregations; pairs of centroids only."""
    centre = centroids(df, label, columns)
    whole = df.agg(F.count("*").alias("total"), *[F.avg(c).alias(f"all_{c}") for c in columns])
    own = centre.select(F.col(label).alias("_l"), "n", *[F.col(c).alias(f"c_{c}") for c in columns])
    sq = lambda a, b: sum(((F.col(a + c) - F.col(b + c)) ** 2 for c in columns[1:]), (F.col(a + columns[0]) - F.col(b + columns[0])) ** 2)
    joined = df.select(label, *columns).join(F.broadcast(own), df[label] == F.col("_l"))
    spread = joined.groupBy("_l").agg(F.sum(sq("", "c_")).alias("within"), F.avg(F.sqrt(sq("", "c_"))).alias("s"))
    stats = own.join(spread, "_l").crossJoin(F.broadcast(whole))
    between = stats.agg(F.count("*").alias("k"), F.sum(F.col("n") * sq("c_", "all_")).alias("b"), F.sum("within").alias("w"), F.max("total").alias("total"))
    ch = F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("total") - F.col("k")))
    left = own.join(spread, "_l").select("_l", "s", *[F.col(f"c_{c}").alias(f"l_{c}") for c in columns])
    right = own.join(spread, "_l").select(F.col("_l").alias("_m"), F.col("s").alias("t"), *[F.col(f"c_{c}").alias(f"r_{c}") for c in columns])
    # the number of groups squared, never rows
    worst = left.join(F.broadcast(right), F.col("_l") != F.col("_m")).groupBy("_l").agg(F.max((F.col("s") + F.col("t")) / F.sqrt(sq("l_", "r_"))).alias("r"))
    return between.select(ch.alias("calinski_harabasz")).crossJoin(worst.agg(F.avg("r").alias("davies_bouldin")))


def silhouette(df: DataFrame, label: str, columns: list[str], row_id: str, sample: int = 5000, seed: int = 42) -> DataFrame:
    """(label, silhouette) means over a sample drawn by hash, with exact Euclidean distances within it, in blocks."""
    rows = df.select(F.col(row_id).alias("i"), F.col(label).alias("l"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).orderBy(F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)))), "i").limit(sample).toPandas()
    x, labels = np.array(rows["x"].tolist(), float), rows["l"].to_numpy()
    names = np.unique(labels)
    out = np.zeros(len(x))
    for low in range(0, len(x), 512):
        d = np.sqrt(np.maximum((x[low : low + 512] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[low : low + 512] @ x.T, 0))
        mean = np.stack([d[:, labels == n].sum(1) for n in names], 1)
        count = np.array([(labels == n).sum() for n in names])
        for k in range(len(d)):
            own = int(np.searchsorted(names, labels[low + k]))
            if count[own] == 1:
                continue
            a = mean[k, own] / (count[own] - 1)
            b = min(mean[k, j] / count[j] for j in range(len(names)) if j != own) if len(names) > 1 else a
            out[low + k] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    table = pd.DataFrame({"label": labels, "silhouette": out}).groupby("label", as_index=False).agg(n=("silhouette", "size"), silhouette=("silhouette", "mean"))
    return df.sparkSession.createDataFrame([(str(r.label), int(r.n), float(r.silhouette)) for r in table.itertuples()], "label string, n long, silhouette double")


def choose(df: DataFrame, columns: list[str], row_id: str, ks: range, algorithms: tuple[str, ...] = ("kmeans",), features: str = "features") -> tuple[object, list[dict]]:
    """The model with the best mean silhouette over numbers of groups and algorithms, and all that were tried."""
    tried: list[dict] = []
    for a in algorithms:
        for k in ks:
            model = fit(df, a, k, features)
            found = model.transform(df).withColumn("prediction", F.col("prediction").cast("int"))
            rows = silhouette(found, "prediction", columns, row_id).collect()
            mean = sum(r["n"] * r["silhouette"] for r in rows) / max(1, sum(r["n"] for r in rows))
            tried.append({"algorithm": a, "k": k, "silhouette": mean, "model": model})
    best = max(tried, key=lambda t: (t["silhouette"], -t["k"]))
    return best["model"], tried


def assign_by_neighbours(new: DataFrame, known: DataFrame, columns: list[str], label: str, row_id: str, k: int = 5) -> DataFrame:
    """new with cluster: the commonest label of the k nearest of all known rows, ties to the smaller label.

    Rows of new that are alike in columns are one query; what isn't a finite number counts as 0.
    """
    points = stored(known.select(F.monotonically_increasing_id().alias("id"), point(columns).alias("x"), F.col(label).cast("int").alias("l")), "known")
    asked = stored(new.select(point(columns).alias("x")).distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    near = nearest_rows(asked, "id", F.col("x"), len(columns), k, points=points)
    votes = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other")).join(points.select(F.col("id").alias("other"), "l"), "other")
    most = votes.groupBy("id", "l").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("cluster"))
    told = asked.join(most, "id").select(F.col("x").alias("_x"), "cluster")
    return new.withColumn("_p", point(columns)).join(told, F.col("_p") == F.col("_x")).drop("_p", "_x")


def describe_numeric(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(cluster, column, mean, z): each group's mean and its distance from the whole in sample deviations; cluster 'all' too."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")
    long = df.select(F.col(label).cast("string").alias("cluster"), parts).select("cluster", "r.*")
    own = long.rollup("column", "cluster").agg(F.avg("x").alias("mean"), F.grouping_id().alias("g")).where("g <= 1 and column is not null")
    whole = long.groupBy("column").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return own.join(F.broadcast(whole), "column").select(F.coalesce("cluster", F.lit("all")).alias("cluster"), "column", "mean", ((F.col("mean") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"))


def between_spread(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(column, spread): how far group means differ, in deviations of the column, largest first."""
    table = describe_numeric(df, label, columns).where("cluster <> 'all'")
    return table.groupBy("column").agg(F.stddev_pop("z").alias("spread")).orderBy(F.desc("spread"), "column")


def describe_categories(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(cluster, column, value, share, lift): each group's commonest value, and its share over that in all rows."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")
    counts = df.select(F.col(label).cast("string").alias("cluster"), parts).select("cluster", "r.*").where("value is not null").groupBy("cluster", "column", "value").agg(F.count("*").alias("n"))
    size = counts.groupBy("cluster", "column").agg(F.sum("n").alias("t"), F.max(F.struct("n", "value")).alias("_top"))
    best = counts.groupBy("cluster", "column").agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("b"), F.sum("n").alias("t")).select("cluster", "column", F.col("b.value").alias("value"), (-F.col("b.k") / F.col("t")).alias("share"))
    overall = counts.groupBy("column", "value").agg(F.sum("n").alias("n")).join(counts.groupBy("column").agg(F.sum("n").alias("t")), "column").select("column", "value", (F.col("n") / F.col("t")).alias("p"))
    del size
    return best.join(overall, ["column", "value"]).select("cluster", "column", "value", "share", (F.col("share") / F.col("p")).alias("lift"))


def projection(df: DataFrame, features: str = "features", rows: int = 1200, seed: int = 42) -> DataFrame:
    """x and y of at most rows rows, drawn by hash: the first two principal components of centred features."""
    from pyspark.ml.feature import PCA, StandardScaler

    scaled = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_s").fit(df).transform(df)
    model = PCA(k=2, inputCol="_s", outputCol="_p").fit(scaled)
    some = scaled.orderBy(F.xxhash64(vector_to_array(features), F.lit(seed))).limit(rows)
    p = vector_to_array("_p")
    return model.transform(some).select("*", p[0].alias("x"), p[1].alias("y")).drop("_s", "_p")
