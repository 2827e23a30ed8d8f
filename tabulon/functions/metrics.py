"""Metrics of predictions, as aggregations. Tables have a column for the truth and one for the prediction or its probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIASES = {"f1": "f1_macro", "f1_score": "f1_macro", "auc": "roc_auc", "acc": "accuracy", "logloss": "log_loss", "mse": "rmse", "r_squared": "r2", "balanced": "balanced_accuracy"}
HIGHER_IS_BETTER = {"f1_macro": True, "accuracy": True, "balanced_accuracy": True, "precision": True, "recall": True, "roc_auc": True, "r2": True, "log_loss": False, "rmse": False, "mae": False, "mape": False}


def metric_name(name: str) -> str:
    """The metric that a name or alias means."""
    bare = name.strip().lower().replace("-", "_").replace(" ", "_")
    found = ALIASES.get(bare, bare)
    if found not in HIGHER_IS_BETTER:
        raise ValueError(f"no metric {name!r}; there are {', '.join(HIGHER_IS_BETTER)}")
    return found


def confusion(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """(actual, predicted, n, row_share)."""
    counts = df.groupBy(F.col(truth).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def per_class(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """(label, precision, recall, f1, support) of every class that is true or predicted somewhere; 0 where undefined."""
    one = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q"))))
    hit = (F.col(truth) == F.col(predicted)).cast("int")
    counts = df.select(hit.alias("hit"), one.alias("x")).groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.q").alias("chosen"), F.sum(F.col("x.t") * F.col("hit")).alias("tp"))
    safe = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    out = counts.select("label", safe("tp", "chosen").alias("precision"), safe("tp", "support").alias("recall"), "support", "tp")
    both = F.col("precision") + F.col("recall")
    return out.select("label", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"), "support", "tp")


def classification(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """One row: accuracy, balanced_accuracy, macro precision, recall and F1."""
    return per_class(df, truth, predicted).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1_macro"))


def _score_counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(s, pos, n) for each distinct score: what ranking metrics need."""
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))


def ranked(df: DataFrame, truth: str = "y", score: str = "s", buckets: int = 64) -> DataFrame:
    """(bucket, s, pos, n, tp, fp, positives, negatives) with tp and fp counted over all scores of at least s.

    Running sums are taken within ranges of the scores and shifted by the totals of higher ranges, so that no window
    holds all distinct scores.
    """
    counts = _score_counts(df, truth, score)
    cuts = counts.agg(F.percentile_approx("s", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("s"))) if cuts else F.lit(0)
    counts = counts.withColumn("bucket", bucket)
    per = counts.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select("bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"), F.sum("bp").over(whole).alias("positives"), F.sum("bn").over(whole).alias("all"))
    w = Window.partitionBy("bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(F.broadcast(per), "bucket").withColumns({"tp": F.sum("pos").over(w) + F.col("p0"), "m": F.sum("n").over(w) + F.col("n0")})
    return out.select("bucket", "s", "pos", "n", "tp", (F.col("m") - F.col("tp")).alias("fp"), "positives", (F.col("all") - F.col("positives")).alias("negatives"))


def ranking(df: DataFrame, truth: str = "y", score: str = "s") -> DataFrame:
    """One row: roc_auc (ties count half) and average_precision, both exact."""
    r = ranked(df, truth, score)
    # pairs won: each positive over the negatives that score less, and half of those that score the same
    won = F.col("pos") * (F.col("negatives") - F.col("fp")) + F.col("pos") * (F.col("n") - F.col("pos")) / 2
    ap = F.try_divide(F.col("pos"), F.col("positives")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return r.agg(F.try_divide(F.sum(won), F.max(F.col("positives") * F.col("negatives"))).alias("roc_auc"), F.sum(ap).alias("average_precision"))


def curve(df: DataFrame, truth: str = "y", score: str = "s", points: int = 150) -> DataFrame:
    """(s, tpr, fpr, precision) at no more than points evenly spaced distinct scores."""
    r = ranked(df, truth, score)
    n = r.count()
    step = max(1, -(-n // points))
    # a score's number is its range's place and its own in the range, so that no window holds all of them
    w = Window.partitionBy("bucket").orderBy(F.desc("s"))
    before = r.groupBy("bucket").count().select("bucket", (F.sum("count").over(Window.orderBy(F.desc("bucket"))) - F.col("count")).alias("before"))
    r = r.join(F.broadcast(before), "bucket").withColumn("k", F.row_number().over(w) + F.col("before"))
    return r.where((F.col("k") % step == 0) | (F.col("k") == n)).select("s", (F.col("tp") / F.col("positives")).alias("tpr"), (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def log_loss(truth: Column, probability: Column, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(probability, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-F.ln(F.when(truth == 1, p).otherwise(1 - p)))


def regression(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """One row: rmse, mae, r2, mape (null with a truth of 0), and the residuals' mean, deviation and 5% and 95% points."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    e = y - p
    mape = F.when(F.min(F.abs(y)) > 0, F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))))
    r2 = 1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))
    from tabulon.operators.quantiles import exact_quantiles

    q = [F.lit(v).cast("double") for v in exact_quantiles(df, {"e": e}, [0.05, 0.95])["e"] or (None, None)]
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), mape.alias("mape"), F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"), q[0].alias("p05"), q[1].alias("p95"))


def calibration(df: DataFrame, truth: str = "y", probability: str = "s", bins: int = 10, order: str | None = None) -> DataFrame:
    """(bin, n, mean_probability, share) of bins of equal counts by probability; neighbours of equal means are one bin.

    Positions come from ranks within ranges of the probability, as in ranked(), and, so that a probability that most
    rows have is no single task's, within 64 ranges of order, which breaks ties.
    """
    cols = [F.col(probability).alias("s"), F.col(truth).cast("double").alias("y"), (F.col(order) if order else F.monotonically_increasing_id()).alias("o")]
    rows = df.select(*cols)
    n = rows.count()
    sixty = F.array(*[F.lit(k / 64) for k in range(1, 64)])
    found = rows.agg(F.percentile_approx("s", sixty, 1000).alias("c"), F.percentile_approx(F.col("o").cast("double"), sixty, 1000).alias("d")).first()
    inside = lambda cuts, c: F.size(F.filter(F.array(*[F.lit(v) for v in sorted(set(cuts))]), lambda v: v <= c)) if cuts else F.lit(0)
    # scores that a cut falls on, as frequent ones do, are ranges of their own, in which rows are dealt by order
    cuts = sorted(set(found["c"] or []))
    rows = rows.withColumn("bucket", 2 * inside(cuts, F.col("s")) - F.col("s").isin(cuts).cast("int") if cuts else F.lit(0))
    rows = rows.withColumn("part", F.when(F.col("bucket") % 2 == 1, inside(found["d"], F.col("o").cast("double"))).otherwise(0))
    sizes = rows.groupBy("bucket", "part").count()
    before = sizes.select("bucket", "part", (F.sum("count").over(Window.orderBy("bucket", "part")) - F.col("count")).alias("before"))
    place = rows.join(F.broadcast(before), ["bucket", "part"]).withColumn("k", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("s", "o")) + F.col("before"))
    big, size = n % bins, n // bins
    tile = F.when(F.col("k") <= big * (size + 1), F.floor((F.col("k") - 1) / (size + 1))).otherwise(big + F.floor((F.col("k") - 1 - big * (size + 1)) / max(1, size)))
    means = place.groupBy(tile.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("m"), F.avg("y").alias("share"))
    w = Window.orderBy("bin")
    group = F.sum(F.when(F.lag("m").over(w) == F.col("m"), 0).otherwise(1)).over(w)
    return means.withColumn("g", group).groupBy("g").agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean_probability"), (F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("share")).select((F.col("g") - 1).cast("int").alias("bin"), "n", "mean_probability", "share")


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: expected calibration error and a verdict."""
    ece = F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("share"))) / F.sum("n")
    return bins.agg(ece.alias("ece")).withColumn("verdict", F.when(F.col("ece") <= 0.03, "good").when(F.col("ece") <= 0.08, "fair").otherwise("poor"))


def brier(truth: Column, probability: Column) -> Column:
    return F.avg((probability - truth) * (probability - truth))


def multilabel(df: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """One row of f1_micro, f1_macro, exact_match, hamming, precision_micro, recall_micro; labels: (truth, predicted) 0/1 columns."""
    sums, right, wrong = [], F.lit(True), F.lit(0)
    for k, (y, p) in enumerate(labels):
        sums += [F.sum(F.col(y) * F.col(p)).alias(f"tp{k}"), F.sum(F.col(y)).alias(f"t{k}"), F.sum(F.col(p)).alias(f"p{k}")]
        right = right & (F.col(y) == F.col(p))
        wrong = wrong + (F.col(y) != F.col(p)).cast("int")
    row = df.agg(*sums, F.avg(right.cast("double")).alias("exact_match"), (F.avg(wrong) / len(labels)).alias("hamming"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    add = lambda tag: sum((F.col(f"{tag}{k}") for k in range(1, len(labels))), F.col(f"{tag}0"))
    tp, t, p = add("tp"), add("t"), add("p")
    macro = sum((safe(2 * F.col(f"tp{k}"), F.col(f"t{k}") + F.col(f"p{k}")) for k in range(1, len(labels))), safe(2 * F.col("tp0"), F.col("t0") + F.col("p0"))) / len(labels)
    return row.select(safe(2 * tp, t + p).alias("f1_micro"), macro.alias("f1_macro"), "exact_match", "hamming", safe(tp, p).alias("precision_micro"), safe(tp, t).alias("recall_micro"))


def overfit(train: float, valid: float, bounded: bool) -> bool:
    """Whether a score on training data is too far from the one on new data."""
    return train - valid > 0.25 if bounded else valid > 4 * max(train, 1e-12)


def weak_signal(metric: str, value: float, baseline: float | None = None) -> bool:
    if metric == "roc_auc":
        return value < 0.6
    if metric == "r2":
        return value < 0.05
    return baseline is not None and abs(value - baseline) < 0.02 * max(abs(baseline), 1e-12)
