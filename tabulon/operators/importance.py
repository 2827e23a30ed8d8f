"""How much columns matter: filter methods in SQL, model-based ones on pyspark.ml, and what they agree on."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.values import show_number
from tabulon.operators.profile import unpivoted
from tabulon.operators.quantiles import exact_quantiles, medians
from tabulon.sources.scratch import stored

#: Distinct values whose ranks are broadcast at most; beyond, the join shuffles.
BROADCAST_VALUES = 1_000_000


def _long(df: DataFrame, columns: list[str], *others: Column) -> DataFrame:
    return df.select(*others, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select(*[o for o in _names(others)], "r.*")


def _names(columns: tuple[Column, ...]) -> list[str]:
    return ["y", "row"][: len(columns)]


def f_test(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): between over within variance of a class target."""
    rows = _long(df, columns, F.col(target).cast("string").alias("y")).where("x is not null and y is not null")
    per = rows.groupBy("column", "y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("w"))
    whole = rows.groupBy("column").agg(F.avg("x").alias("a"))
    sums = per.join(F.broadcast(whole), "column").groupBy("column").agg(F.sum(F.col("n") * (F.col("m") - F.col("a")) ** 2).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return sums.select("column", (F.col("b") / (F.col("k") - 1) / F.greatest(F.col("w") / (F.col("n") - F.col("k")), 1e-12 * F.col("b"), F.lit(1e-300))).alias("score"))


def f_regression(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): the F statistic of a line through a numeric target."""
    y = F.col(target).cast("double")
    out = []
    for c in columns:
        r, n = F.coalesce(F.corr(F.col(c).cast("double"), y), F.lit(0.0)), F.count(F.when(F.col(c).isNotNull() & y.isNotNull(), 1))
        out.append((r * r / F.greatest(1 - r * r, F.lit(1e-12)) * (n - 2)).alias(f"{c}__score"))
    return unpivoted(df.agg(*out), columns, ["score"])


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank of column from 1, ties sharing their mean rank; ranks come from counts of distinct values."""
    counts = stored(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")), "counts")
    cuts = sorted(set(counts.agg(F.percentile_approx("_v", F.array(*[F.lit(k / 64) for k in range(1, 64)]), 1000).alias("c")).first()["c"] or []))
    counts = counts.withColumn("_b", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_v"))) if cuts else F.lit(0))
    before = counts.groupBy("_b").agg(F.sum("_n").alias("_t")).select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_low"))
    w = Window.partitionBy("_b").orderBy("_v")
    ranks = counts.join(F.broadcast(before), "_b").select("_v", (F.col("_low") + F.sum("_n").over(w) - (F.col("_n") - 1) / 2).alias(name))
    few = counts.count() <= BROADCAST_VALUES
    return df.join(F.broadcast(ranks) if few else ranks, df[column] == F.col("_v"), "left").drop("_v")


def _with_ranks(df: DataFrame, columns: list[str], plain: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with the ranks of columns, and the name of each; those of plain, of two values, are a line through them and stay.

    After every eight columns the table is written, so that a wide one isn't one plan of as many joins.
    """
    names = {c: c if c in plain else f"_r_{c}" for c in columns}
    for k, (c, name) in enumerate((c, n) for c, n in names.items() if n != c):
        df = average_ranks(stored(df, "ranks") if k and k % 8 == 0 else df, c, name)
    return df, names


def rank_correlation(df: DataFrame, columns: list[str], target: str, plain: list[str] = ()) -> DataFrame:
    """(column, score): the absolute correlation of ranks with a numeric target; columns of plain have two values."""
    rows, names = _with_ranks(df.select(target, *columns), [target, *columns], list(plain))
    return unpivoted(rows.agg(*[F.coalesce(F.abs(F.corr(names[c], names[target])), F.lit(0.0)).alias(f"{c}__score") for c in columns]), columns, ["score"])


def chi_square(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): sums of columns scaled to 0..1 by class, against what the class shares lead to expect."""
    low = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__low") for c in columns], *[F.max(F.col(c).cast("double")).alias(f"{c}__high") for c in columns]).first()
    scaled = df.select(target, *[((F.col(c) - low[f"{c}__low"]) / ((low[f"{c}__high"] - low[f"{c}__low"]) or 1.0)).alias(c) for c in columns])
    rows = _long(scaled, columns, F.col(target).cast("string").alias("y")).where("x is not null and y is not null")
    per = rows.groupBy("column", "y").agg(F.sum("x").alias("o"), F.count("*").alias("n"))
    whole = per.groupBy("column").agg(F.sum("o").alias("s"), F.sum("n").alias("t"))
    e = F.col("n") / F.col("t") * F.col("s")
    return per.join(F.broadcast(whole), "column").groupBy("column").agg(F.sum((F.col("o") - e) ** 2 / e).alias("score"))


def variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, score): sample variance of columns scaled to 0..1."""
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        out.append((F.var_samp(x) / F.nullif((F.max(x) - F.min(x)) ** 2, F.lit(0.0))).alias(f"{c}__score"))
    return unpivoted(df.agg(*out), columns, ["score"])


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """(column, score): in nats, of columns cut at their deciles and a class target."""
    cuts = exact_quantiles(df, {c: F.col(c) for c in columns}, [k / bins for k in range(1, bins)])
    place = lambda c: F.size(F.filter(F.array(*[F.lit(v) for v in sorted(set(cuts[c] or []))]), lambda v: v <= F.col(c))).cast("double")
    binned = df.select(F.col(target).cast("string").alias("y"), *[place(c).alias(c) for c in columns])
    rows = _long(binned, columns, F.col("y")).where("y is not null")
    joint = rows.groupBy("column", "x", "y").agg(F.count("*").alias("n"))
    n = joint.groupBy("column").agg(F.sum("n").alias("t"))
    px = joint.groupBy("column", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("column", "y").agg(F.sum("n").alias("ny"))
    p = joint.join(px, ["column", "x"]).join(py, ["column", "y"]).join(F.broadcast(n), "column")
    return p.groupBy("column").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("score"))


def consensus(scores: DataFrame, top: int = 5) -> DataFrame:
    """(column, mean_rank, consensus_rank, agreement, score) from (method, column, score) rows.

    A column that a method lacks scores 0 there; ranks share the smallest place; agreement is the share of methods with
    the column among their top ones; the variance method has no vote, unless it is the only one.
    """
    votes = scores.where("method <> 'variance'")
    votes = votes if not votes.isEmpty() else scores
    grid = votes.select("method").distinct().crossJoin(votes.select("column").distinct())
    full = grid.join(votes, ["method", "column"], "left").na.fill(0.0, ["score"])
    by = Window.partitionBy("method")
    ranked = full.withColumn("rank", F.rank().over(by.orderBy(F.desc("score")))).withColumn("part", F.col("score") / F.nullif(F.max("score").over(by), F.lit(0.0)))
    out = ranked.groupBy("column").agg(F.avg("rank").alias("mean_rank"), F.avg((F.col("rank") <= top).cast("double")).alias("agreement"), F.avg(F.coalesce("part", F.lit(0.0))).alias("score"))
    return out.withColumn("consensus_rank", F.row_number().over(Window.orderBy("mean_rank", "column"))).select("column", "mean_rank", "consensus_rank", "agreement", "score")


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])).alias("features"))


def redundancy(df: DataFrame, columns: list[str], least: float = 0.9) -> tuple[list[list[str]], list[tuple[str, str, float]], dict[str, float]]:
    """Groups and pairs of columns with a rank correlation of at least least, and variance inflation factors.

    Nulls count as 0. Ranks come from counts of distinct values. The correlation matrix, columns squared, is all that
    reaches the driver.
    """
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    ranked, names = _with_ranks(filled, columns, [])
    both = Correlation.corr(_vector(ranked, [*columns, *names.values()]), "features", "pearson").first()[0].toArray()
    p, m = both[: len(columns), : len(columns)], both[len(columns) :, len(columns) :]
    pairs = [(columns[i], columns[j], float(m[i, j])) for i, j in itertools.combinations(range(len(columns)), 2) if abs(m[i, j]) >= least]
    up = {c: c for c in columns}

    def root(c: str) -> str:
        while up[c] != c:
            c = up[c]
        return c

    for a, b, _ in pairs:
        up[root(b)] = root(a)
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(root(c), []).append(c)
    inverse = np.diag(np.linalg.pinv(p))
    return [g for g in groups.values() if len(g) > 1], pairs, {c: float(v) for c, v in zip(columns, inverse, strict=True)}


def forest(df: DataFrame, columns: list[str], target: str, classes: bool, trees: int = 50, seed: int = 42, shadows: bool = True) -> dict[str, float]:
    """Importances of a random forest, less the best of those of shuffled copies."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    rows = df.select(F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns])
    names = list(columns)
    if shadows:
        rows = shuffled(rows, columns, seed, "shadow_")
        names += [f"shadow_{c}" for c in columns]
    made = RandomForestClassifier if classes else RandomForestRegressor
    model = made(numTrees=trees, seed=seed, maxDepth=6).fit(_vector(rows, names).select("label", "features"))
    found = model.featureImportances.toArray()
    floor = max(found[len(columns) :], default=0.0) if shadows else 0.0
    return {c: max(0.0, float(v) - float(floor)) for c, v in zip(columns, found, strict=False)}


def shuffled(df: DataFrame, columns: list[str], seed: int = 42, prefix: str = "shuffled_") -> DataFrame:
    """df with copies of columns, moved together to other rows: positions in one random order meet those in another.

    Positions are a range partition's offset plus a rank inside it, so no window holds all rows.
    """
    one = _numbered(df.withColumn("_o", F.xxhash64(*df.columns, F.lit(seed))), "_o", "_k")
    two = _numbered(df.select(*[F.col(c).alias(prefix + c) for c in columns]).withColumn("_o", F.xxhash64(*[prefix + c for c in columns], F.lit(seed + 1), F.monotonically_increasing_id())), "_o", "_k")
    return one.join(two, "_k").drop("_k")


def _numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    parts = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    before = parts.groupBy("_p").count().select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
    return parts.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b", order)


def permutation(df: DataFrame, columns: list[str], predict: Callable[[DataFrame], DataFrame], loss: Callable[[DataFrame], float], repeats: int = 5, seed: int = 42) -> dict[str, float]:
    """How much a model's loss grows when a column is shuffled, on average over repeats."""
    base = loss(predict(df))
    out = {}
    for c in columns:
        worse = []
        for r in range(repeats):
            mixed = shuffled(df, [c], seed + r)
            worse.append(loss(predict(mixed.withColumn(c, F.col(f"shuffled_{c}")).drop(f"shuffled_{c}"))) - base)
        out[c] = sum(worse) / len(worse)
    return out


def weights(df: DataFrame, columns: list[str], target: str, classes: bool, l1: float = 0.0) -> dict[str, float]:
    """Absolute weights of a linear model on standardised columns, with an L1 penalty if given."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    rows = _vector(df, columns).select(F.col(target).cast("double").alias("label"), "features")
    std = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    made = LogisticRegression if classes else LinearRegression
    model = made(regParam=l1 or 0.0, elasticNetParam=1.0 if l1 else 0.0).fit(rows)
    w = np.abs(model.coefficientMatrix.toArray()).max(0) if classes else np.abs(model.coefficients.toArray())
    return {c: float(v * (std[c] or 0.0)) for c, v in zip(columns, w, strict=True)}


def stability(df: DataFrame, columns: list[str], target: str, row_id: str, classes: bool, rounds: int = 50, l1: float = 0.02, seed: int = 42) -> dict[str, float]:
    """The share of half samples in which an L1 model keeps a column."""
    from tabulon.operators.splits import place

    hits = dict.fromkeys(columns, 0)
    for r in range(rounds):
        half = df.where(F.conv(F.substring(place(row_id, seed + r), 1, 1), 16, 10).cast("int") < 8)
        for c, w in weights(half, columns, target, classes, l1).items():
            hits[c] += w > 1e-6
    return {c: h / rounds for c, h in hits.items()}


def boruta(df: DataFrame, columns: list[str], target: str, classes: bool, rounds: int = 20, seed: int = 42, level: float = 0.05) -> dict[str, bool]:
    """Columns that beat all shuffled copies more often than chance would let them."""
    hits = dict.fromkeys(columns, 0)
    for r in range(rounds):
        for c, v in forest(df, columns, target, classes, trees=20, seed=seed + r).items():
            hits[c] += v > 0
    tail = lambda h: sum(math.comb(rounds, k) for k in range(h, rounds + 1)) / 2**rounds
    return {c: tail(h) < level for c, h in hits.items()}


def search(columns: list[str], evaluate: Callable[[list[str]], float], direction: str = "forward", most: int | None = None) -> list[tuple[list[str], float]]:
    """Forward selection, backward elimination or, up to ten columns, all subsets; evaluate gives a score of a set, higher is better."""
    if direction == "exhaustive":
        if len(columns) > 10:
            raise ValueError("all subsets are tried for up to ten columns")
        return [(list(s), evaluate(list(s))) for n in range(1, len(columns) + 1) for s in itertools.combinations(columns, n)]
    if len(columns) > 30:
        raise ValueError("step by step selection is for up to 30 columns")
    path: list[tuple[list[str], float]] = []
    now = [] if direction == "forward" else list(columns)
    while (len(now) < (most or len(columns))) if direction == "forward" else len(now) > 1:
        options = [[*now, c] for c in columns if c not in now] if direction == "forward" else [[x for x in now if x != c] for c in now]
        best = max(((o, evaluate(o)) for o in options), key=lambda t: t[1])
        now = best[0]
        path.append(best)
    return path


def enough(points: list[tuple[int, float]], margin: float = 0.01, spreads: dict[int, float] | None = None) -> int:
    """The fewest columns whose score is within a margin, or one spread of the best, of the best score."""
    best_n, best = max(points, key=lambda p: (p[1], -p[0]))
    slack = spreads[best_n] if spreads else margin * max(abs(best), 1e-12)
    return min(n for n, s in points if s >= best - slack)


def effect(df: DataFrame, column: str, predict: Callable[[DataFrame], DataFrame], prediction: str = "prediction", points: int = 9, sample: int = 300) -> DataFrame:
    """(value, mean): the mean prediction of a bounded sample of rows with column set to points from its 5% to its 95% point."""
    q = [0.05 + 0.9 * k / (points - 1) for k in range(points)]
    grid = sorted(set(exact_quantiles(df, {column: F.col(column)}, q)[column] or []))
    some = df.orderBy(F.xxhash64(*df.columns)).limit(sample)
    varied = some.withColumn("_v", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn(column, F.col("_v").cast(dict(df.dtypes)[column]))
    return predict(varied).groupBy(F.col("_v").alias("value")).agg(F.avg(prediction).alias("mean"))


def explain_rows(rows: DataFrame, columns: list[str], typical: dict[str, object], predict: Callable[[DataFrame], DataFrame], row_id: str, prediction: str = "prediction") -> DataFrame:
    """(row_id, column, prediction, effect): how a row's prediction changes when one column takes its typical value; in one scoring."""
    types = dict(rows.dtypes)
    varied = rows.withColumn("_c", F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns])))
    varied = varied.withColumns({c: F.when(F.col("_c") == c, F.lit(typical[c]).cast(types[c])).otherwise(F.col(c)) for c in columns})
    scored = predict(varied).select(row_id, "_c", F.col(prediction).alias("p"))
    base = scored.where("_c = ''").select(row_id, F.col("p").alias("prediction"))
    return scored.where("_c <> ''").join(base, row_id).select(row_id, F.col("_c").alias("column"), "prediction", (F.col("prediction") - F.col("p")).alias("effect"))


def sentences(rows: list[dict], row_id: str, most: int = 2) -> list[str]:
    """A sentence for each row of explain_rows(): the columns that moved its prediction most, and which way."""
    by_row: dict = {}
    for r in rows:
        by_row.setdefault(r[row_id], []).append(r)
    out = []
    for i, parts in sorted(by_row.items(), key=lambda x: str(x[0])):
        far = sorted((p for p in parts if p["effect"]), key=lambda p: (-abs(p["effect"]), p["column"]))[:most]
        said = " and ".join(f"{p['column']} {'raises' if p['effect'] > 0 else 'lowers'} it by {show_number(abs(p['effect']))}" for p in far)
        out.append(f"Row {i}: the answer is {show_number(parts[0]['prediction'])}; {said or 'no single column changes it'}.")
    return out


def sensitivity(df: DataFrame, columns: list[str], predict: Callable[[DataFrame], DataFrame], row_id: str, numbers: bool, seed: int = 42) -> dict[str, float]:
    """Without labels: the mean change of numeric predictions, or the share of answers that change, when a column is shuffled."""
    base = predict(df).select(F.col(row_id).alias("_i"), F.col("predicted").alias("_b"))
    out = {}
    for c in columns:
        mixed = shuffled(df, [c], seed).withColumn(c, F.col(f"shuffled_{c}")).drop(f"shuffled_{c}")
        both = predict(mixed).select(row_id, "predicted").join(base, F.col(row_id) == F.col("_i"))
        change = F.abs(F.col("predicted") - F.col("_b")) if numbers else (~F.col("predicted").eqNullSafe(F.col("_b"))).cast("double")
        out[c] = both.agg(F.avg(change)).first()[0] or 0.0
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def drop_column(columns: list[str], evaluate: Callable[[list[str]], float]) -> dict[str, float]:
    """How much a score of all columns falls when one of them is left out; evaluate is higher for better sets."""
    whole = evaluate(columns)
    return {c: whole - evaluate([x for x in columns if x != c]) for c in columns} if len(columns) > 1 else {c: whole for c in columns}


def eliminated(columns: list[str], weigh: Callable[[list[str]], dict[str, float]], step: float = 0.1) -> dict[str, float]:
    """Recursive elimination: the least of the remaining columns, a tenth of them at a time, go by a model fitted on them.

    weigh gives a weight of each of a set of columns. The score is the round in which a column went, over all rounds; those
    of the last round score 1.
    """
    left, gone = list(columns), []
    while len(left) > 1:
        w = weigh(left)
        least = sorted(left, key=lambda c: (w[c], c))[: max(1, int(len(left) * step))]
        gone.append(least)
        left = [c for c in left if c not in least]
    gone.append(left)
    return {c: (k + 1) / len(gone) for k, part in enumerate(gone) for c in part}


def tree_weights(df: DataFrame, columns: list[str], target: str, classes: bool, kind: str = "boosting", seed: int = 42) -> dict[str, float]:
    """Importances of boosted trees, or of extra trees: a forest without resampling, on the root of the columns at each split."""
    from pyspark.ml import classification, regression

    rows = _vector(df, columns).select(F.col(target).cast("double").alias("label"), "features")
    if kind == "boosting":
        made = classification.GBTClassifier if classes else regression.GBTRegressor
        many = classes and rows.agg(F.max("label")).first()[0] > 1
        model = classification.OneVsRest(classifier=made(maxIter=20, seed=seed)) if many else made(maxIter=20, seed=seed)
        fitted = model.fit(rows)
        found = np.mean([m.featureImportances.toArray() for m in fitted.models], 0) if many else fitted.featureImportances.toArray()
    else:
        made = classification.RandomForestClassifier if classes else regression.RandomForestRegressor
        found = made(numTrees=50, maxDepth=8, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed).fit(rows).featureImportances.toArray()
    return {c: float(v) for c, v in zip(columns, found, strict=True)}


def columns_needed(ranked: list[str], evaluate: Callable[[list[str]], list[float]], sizes: list[int] | None = None) -> tuple[list[dict], int]:
    """(points, number): the cross-validated score of the first columns, for growing numbers of them, and how many are enough.

    evaluate gives a set's score in each fold, higher for better ones.
    """
    sizes = sizes or sorted({n for n in (1, 2, 3, 5, 8, 12, 20, 30, len(ranked)) if n <= len(ranked)})
    points = []
    for n in sizes:
        scores = evaluate(ranked[:n])
        points.append({"columns": n, "score": float(np.mean(scores)), "spread": float(np.std(scores))})
    return points, enough([(p["columns"], p["score"]) for p in points], spreads={p["columns"]: p["spread"] for p in points})


def best_subsets(found: list[tuple[list[str], float]], columns: list[str], share: float = 0.05) -> dict[str, float]:
    """How often each column is in the best share of the sets that an exhaustive search tried."""
    best = sorted(found, key=lambda f: -f[1])[: max(1, math.ceil(len(found) * share))]
    return {c: sum(c in s for s, _ in best) / len(best) for c in columns}


def spread_of_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, score): 1 less the share of the most frequent value."""
    from tabulon.operators.profile import value_shares

    return value_shares(df, columns).groupBy("column").agg((1 - F.max("share")).alias("score"))


def rank_correlation_of_classes(df: DataFrame, columns: list[str], target: str, plain: list[str] = ()) -> DataFrame:
    """(column, score): the largest absolute rank correlation with one class against the others; columns of plain have two values."""
    classes = [r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).limit(1001).collect()]
    if len(classes) > 1000:
        raise ValueError("the target has over 1000 classes")
    rows = df.where(F.col(target).isNotNull()).select(*columns, *[(F.col(target) == v).cast("double").alias(f"_is{k}") for k, v in enumerate(classes)])
    rows, names = _with_ranks(rows, columns, list(plain))
    return unpivoted(rows.agg(*[F.greatest(*[F.coalesce(F.abs(F.corr(names[c], f"_is{k}")), F.lit(0.0)) for k in range(len(classes))], F.lit(0.0)).alias(f"{c}__score") for c in columns]), columns, ["score"])


def back_to_columns(df: DataFrame, origin: dict[str, str]) -> DataFrame:
    """(column, score) of the raw columns: the sums of those of the encoded columns that come from them."""
    pairs = df.sparkSession.createDataFrame(list(origin.items()), "column string, raw string")
    return df.join(F.broadcast(pairs), "column").groupBy(F.col("raw").alias("column")).agg(F.sum("score").alias("score"))


def category_effect(df: DataFrame, column: str, predict: Callable[[DataFrame], DataFrame], prediction: str = "prediction", top: int = 8, sample: int = 300) -> DataFrame:
    """(value, mean): the mean prediction of a bounded sample of rows with column set to each of its most frequent values."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(top).select(F.col(column).alias("_v"))
    some = df.orderBy(F.xxhash64(*df.columns)).limit(sample)
    varied = some.crossJoin(F.broadcast(values)).withColumn(column, F.col("_v"))
    return predict(varied).groupBy(F.col("_v").alias("value")).agg(F.avg(prediction).alias("mean"))


def typical(df: DataFrame, numeric: list[str], others: list[str]) -> dict[str, object]:
    """Medians and most frequent values."""
    out: dict[str, object] = dict(medians(df, {c: F.col(c) for c in numeric}))
    for c in others:
        most = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count().orderBy(F.desc("count"), "v").first()
        out[c] = most["v"] if most else None
    return out


def probability_of(label_index: Column, probability: str = "probability") -> Column:
    """The probability of the answer that was given."""
    return F.element_at(vector_to_array(probability), label_index.cast("int") + 1)
