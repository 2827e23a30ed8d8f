"""Encoding for models: fitted on one table, applied to any, as select expressions that keep extra columns out."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.values import date, date_parts, number
from tabulon.operators.clean import top_values
from tabulon.operators.profile import infer_kinds
from tabulon.operators.quantiles import medians

LEVELS = 25
TERMS = 300


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns that a model was trained on, with their types; missing ones are null, others are left out."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def missing_columns(df: DataFrame, columns: list[str], strict: bool = False) -> list[str]:
    """Columns that df lacks; an error if it lacks all, or any when strict."""
    gone = [c for c in columns if c not in df.columns]
    if gone and (strict or len(gone) == len(columns)):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return gone


@dataclass
class Encoding:
    """Everything that fit() found: medians, moments, levels, terms.

    formats: for numbers stored as text "number", for dates stored as text their format. texts: terms and their weights.
    """

    numeric: dict[str, dict] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    rare: dict[str, bool] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    formats: dict[str, str] = field(default_factory=dict)
    texts: dict[str, dict] = field(default_factory=dict)
    levels: int = LEVELS

    def inputs(self) -> list[str]:
        """The columns that are encoded."""
        return [*self.numeric, *self.categories, *self.dates, *self.texts]

    def refit(self, df: DataFrame) -> Encoding:
        """The same columns, read the same way, with what df says of them."""
        return fit_encoding(df, list(self.numeric), list(self.categories), self.dates, self.levels, self.formats, list(self.texts))

    def value(self, df: DataFrame, c: str) -> Column:
        """A numeric or date column as such, null where df lacks it."""
        x = F.col(f"`{c}`") if c in df.columns else F.lit(None)
        kind = self.formats.get(c)
        if c in self.dates:
            return date(x, kind) if kind else x.cast("timestamp_ntz")
        return number(x) if kind == "number" else x.cast("double")

    def columns(self) -> list[tuple[str, str]]:
        """(encoded column, column it comes from)."""
        out = []
        for c, s in self.numeric.items():
            out += [(c, c)] + ([(f"{c}__missing", c)] if s["blank"] else [])
        for c, levels in self.categories.items():
            out += [(f"{c}={v}", c) for v in levels] + ([(f"{c}=other", c)] if self.rare[c] else [])
        out += [(f"{c}__{p}", c) for c in self.dates for p in ("year", "month", "day", "dayofweek", "hour", "is_weekend")]
        return out + [(f"{c}~{t}", c) for c, found in self.texts.items() for t in found["terms"]]

    def expressions(self, df: DataFrame) -> list[Column]:
        have = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None)
        out = []
        for c, s in self.numeric.items():
            x = self.value(df, c)
            out.append(((F.coalesce(x, F.lit(s["median"])) - s["mean"]) / s["std"]).alias(c))
            if s["blank"]:
                out.append(x.isNull().cast("double").alias(f"{c}__missing"))
        for c, levels in self.categories.items():
            x = F.coalesce(have(c).cast("string"), F.lit("(missing)"))
            out += [(x == v).cast("double").alias(f"{c}={v}") for v in levels]
            if self.rare[c]:
                out.append((~x.isin(levels)).cast("double").alias(f"{c}=other"))
        for c in self.dates:
            out += [F.coalesce(p.cast("double"), F.lit(-1.0)).alias(f"{c}__{n}") for p, n in zip(date_parts(self.value(df, c)), ("year", "month", "day", "dayofweek", "hour", "is_weekend"), strict=True)]
        return out

    def _counted(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """df with counts of the terms of text columns, and for each an array of their weights, of length 1."""
        from pyspark.ml.feature import CountVectorizerModel

        arrays = []
        for k, (c, found) in enumerate(self.texts.items()):
            x = F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")
            model = CountVectorizerModel.from_vocabulary(found["terms"], f"_words{k}", f"_counts{k}")
            df = model.transform(df.withColumn(f"_words{k}", F.coalesce(terms_of(x), F.array().cast("array<string>"))))
            raw = F.zip_with(vector_to_array(f"_counts{k}"), F.array(*map(F.lit, found["weights"])), lambda n, w: F.when(n > 0, (1 + F.ln(n)) * w).otherwise(0.0))
            arrays.append(_unit(raw))
        return df, arrays

    def table(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        own = self.expressions(df)
        df, arrays = self._counted(df)
        words = [a[k].alias(f"{c}~{t}") for a, (c, found) in zip(arrays, self.texts.items(), strict=True) for k, t in enumerate(found["terms"])]
        return df.select(*[F.col(f"`{c}`") for c in keep], *own, *words)

    def vectors(self, df: DataFrame, keep: list[str] = (), name: str = "features") -> DataFrame:
        """keep and one vector column, assembled without UDFs."""
        own = F.array(*self.expressions(df)).cast("array<double>")
        df, arrays = self._counted(df)
        return df.select(*[F.col(f"`{c}`") for c in keep], array_to_vector(F.concat(own, *arrays) if arrays else own).alias(name))


def _unit(weights: Column) -> Column:
    """An array of numbers scaled to length 1; one of zeros stays as it is."""
    size = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(weights, lambda v: F.coalesce(F.try_divide(v, size), F.lit(0.0)))


def terms_of(c: Column) -> Column:
    """The runs of two or more letters, digits or _ of a text, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\b\w\w+\b)"), 1)


def fit_encoding(df: DataFrame, numeric: list[str], categorical: list[str], dates: list[str] = (), levels: int = LEVELS, formats: dict[str, str] | None = None, texts: list[str] = ()) -> Encoding:
    """Medians, population moments after filling, the levels of categories, and the most frequent terms of texts.

    Of levels there are at most levels, of which one is 'other'; of terms TERMS, ties by name.
    """
    out = Encoding(dates=list(dates), formats=dict(formats or {}), levels=levels)
    if numeric:
        x = {c: out.value(df, c) for c in numeric}
        one = df.agg(*[(F.count("*") - F.count(v)).alias(f"{c}__m") for c, v in x.items()]).first()
        fill = {c: 0.0 if m is None else m for c, m in medians(df, x).items()}
        two = df.agg(*[F.avg(F.coalesce(v, F.lit(fill[c]))).alias(f"{c}__a") for c, v in x.items()], *[F.stddev_pop(F.coalesce(v, F.lit(fill[c]))).alias(f"{c}__s") for c, v in x.items()]).first()
        for c in numeric:
            out.numeric[c] = {"median": fill[c], "mean": two[f"{c}__a"], "std": two[f"{c}__s"] or 1.0, "blank": one[f"{c}__m"] > 0}
    for c in categorical:
        filled = df.select(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("(missing)")).alias("v"))
        found = top_values(filled, "v", levels + 1)
        out.rare[c] = len(found) > levels
        out.categories[c] = found[: levels - 1] if out.rare[c] else found
    rows = df.count() if texts else 0
    for c in texts:
        words = df.select(terms_of(F.col(f"`{c}`").cast("string")).alias("w")).where("w is not null")
        per = words.select(F.explode(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda u: u == t)).alias("n")))).alias("x"))
        known = per.groupBy("x.term").agg(F.sum("x.n").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(TERMS).collect()
        if known:
            out.texts[c] = {"terms": [r["term"] for r in known], "weights": [math.log((1 + rows) / (1 + r["df"])) + 1 for r in known]}
    return out


def fit_auto(df: DataFrame, target: str | None = None) -> Encoding:
    """fit_encoding() with the columns' inferred kinds: numbers and dates stored as text are read as such, texts give terms."""
    kinds = [k for k in infer_kinds(df) if k.name != target]
    pick = lambda kind: [k.name for k in kinds if k.kind == kind]
    formats = {k.name: "number" if k.kind == "numeric" else k.note for k in kinds if k.dtype == "string" and k.kind in ("numeric", "datetime")}
    return fit_encoding(df, pick("numeric"), pick("categorical"), pick("datetime"), formats=formats, texts=pick("text"))


def tf_idf(df: DataFrame, row_id: str, text: str, terms: int = TERMS, stop: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, term, weight): sublinear term frequency times smoothed inverse document frequency, scaled to length 1.

    The terms are the most frequent over all rows, ties by name; a term is a run of two or more letters, digits or _.
    """
    words = df.select(row_id, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\b\w\w+\b)"), 1)).alias("term"))
    if stop:
        words = words.where(~F.col("term").isin(*stop))
    counts = words.groupBy(row_id, "term").agg(F.count("*").alias("tf"))
    known = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(terms)
    n = df.count()
    raw = counts.join(F.broadcast(known), "term").select(row_id, "term", ((1 + F.ln("tf")) * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    size = raw.groupBy(row_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, row_id).select(row_id, "term", (F.col("w") / F.col("size")).alias("weight"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight) with weights n_rows / (n_classes * n)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.join(F.broadcast(whole)).select("class", "n", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))
