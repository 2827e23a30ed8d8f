"""Cleaning: table to table, each step a projection, a filter or one aggregation that feeds a projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.values import cleaned_text, date, number
from tabulon.operators.profile import NUMERIC, infer_kinds, kind_of_type
from tabulon.operators.quantiles import distinct_counts, exact_quantiles, medians

ENCODED = 20


def trim_names(df: DataFrame) -> DataFrame:
    """Column names without spaces at their ends, unless two would become the same."""
    names = [c.strip() for c in df.columns]
    return df.toDF(*names) if len(set(names)) == len(names) else df


def blank_placeholders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Texts trimmed, and those that say 'missing' as null."""
    columns = [c for c, t in df.dtypes if t == "string"] if columns is None else columns
    return df.withColumns({c: cleaned_text(F.col(f"`{c}`")) for c in columns})


def drop_empty_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the columns that hold nothing."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if not row[c] and c not in keep])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def convert(df: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """Text columns as numbers or dates; kinds: column to ("numeric", "") or ("datetime", format)."""
    return df.withColumns({c: number(F.col(f"`{c}`")) if kind == "numeric" else date(F.col(f"`{c}`"), fmt) for c, (kind, fmt) in kinds.items()})


def spellings(df: DataFrame, columns: list[str], most: int = 500) -> DataFrame:
    """(column, folded, spelling): the most frequent spelling of each value up to case and outer spaces; ties by text.

    Columns of more than most distinct values are left out, so the result has at most most rows for each column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column").agg(F.count("*").alias("values")).where(F.col("values") <= most).select("column")
    folded = F.lower(F.trim("value"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return counts.join(F.broadcast(few), "column").groupBy("column", folded.alias("folded")).agg(best.alias("b"), F.count("*").alias("variants")).select("column", "folded", F.col("b.value").alias("spelling"), "variants")


def unify_spellings(df: DataFrame, columns: list[str], most: int = 500) -> DataFrame:
    """Values as their most frequent spelling. The replacement table has at most most rows a column and is broadcast."""
    table = spellings(df, columns, most).where("variants > 1")
    for c in columns:
        own = table.where(F.col("column") == c).select(F.col("folded").alias("_f"), F.col("spelling").alias("_s"))
        df = df.join(F.broadcast(own), F.lower(F.trim(F.col(f"`{c}`"))) == F.col("_f"), "left").withColumn(c, F.coalesce("_s", F.col(f"`{c}`"))).drop("_f", "_s")
    return df


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows."""
    return df.dropDuplicates()


def fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper bound of each numeric column with over ten distinct values and a spread between its quartiles."""
    named = {c: F.col(f"`{c}`").cast("double") for c in columns}
    quartiles, distinct, out = exact_quantiles(df, named, [0.25, 0.75]), distinct_counts(df, named), {}
    for c in columns:
        q = quartiles[c]
        if q and distinct[c] > 10 and q[1] > q[0]:
            out[c] = (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0]))
    return out


def clip_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Numbers beyond the fences moved to them; nulls stay."""
    bounds = fences(df, columns, factor)
    clipped = {}
    for c, (low, high) in bounds.items():
        x = F.col(f"`{c}`").cast("double")
        clipped[c] = F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)
    return df.withColumns(clipped) if clipped else df


def remove_outliers(df: DataFrame, columns: list[str], factor: float = 1.5, most: float = 0.1) -> DataFrame:
    """Without rows beyond a fence, unless more than most of all rows would go."""
    bounds = fences(df, columns, factor)
    if not bounds:
        return df
    out = F.lit(False)
    for c, (low, high) in bounds.items():
        out = out | F.coalesce(~F.col(f"`{c}`").between(low, high), F.lit(False))
    share = df.agg(F.avg(out.cast("double"))).first()[0] or 0.0
    return df if share > most else df.where(~out)


def impute(df: DataFrame, numeric: list[str], others: list[str]) -> DataFrame:
    """Medians for missing numbers, the most frequent value (the smallest of equals) for the rest."""
    row: dict = medians(df, {c: F.col(f"`{c}`") for c in numeric})
    for c in others:
        most = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).count().orderBy(F.desc("count"), "v").first()
        row[c] = most["v"] if most else None
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("double") if c in numeric else F.col(f"`{c}`"), F.lit(row[c])) for c in [*numeric, *others] if row[c] is not None}
    return df.withColumns(filled) if filled else df


def top_values(df: DataFrame, column: str, top: int) -> list[str]:
    rows = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(top).collect()
    return [r["v"] for r in rows]


def one_hot(df: DataFrame, columns: list[str], top: int = ENCODED) -> DataFrame:
    """A 0/1 column for each of the top values of each column, and <column>_other if it has more."""
    for c in columns:
        found = top_values(df, c, top + 1)
        values, more = found[:top], len(found) > top
        x = F.col(f"`{c}`").cast("string")
        new = {f"{c}_{v}": F.coalesce((x == v).cast("int"), F.lit(0)) for v in values}
        if more:
            new[f"{c}_other"] = F.coalesce((~x.isin(values)).cast("int"), F.lit(0))
        df = df.withColumns(new).drop(c)
    return df


def drop_single_classes(df: DataFrame, target: str) -> DataFrame:
    """Without classes of one row: a semi-join with the classes of more, whose counts are combined before they move."""
    many = df.groupBy(F.col(target).alias("_y")).agg(F.count("*").alias("_n")).where("_n >= 2 and _y is not null")
    return df.join(many, df[target] == F.col("_y"), "left_semi")


@dataclass
class Cleaned:
    data: DataFrame
    steps: list[str] = field(default_factory=list)


def clean(df: DataFrame, target: str | None = None, outliers: str = "none", fill: bool = False, encode: bool = False, drop_ids: bool = True) -> Cleaned:
    """All steps in order; outliers: none, clip or remove."""
    if outliers not in ("none", "clip", "remove"):
        raise ValueError("outliers is none, clip or remove")
    out = Cleaned(trim_names(df), ["names"])
    out.data = drop_empty_rows(drop_empty_columns(blank_placeholders(out.data), (target,) if target else ()))
    out.steps += ["placeholders", "empty columns", "empty rows"]
    kinds = infer_kinds(out.data)
    typed = {k.name: ("numeric", "") if k.kind == "numeric" else ("datetime", k.note) for k in kinds if k.dtype == "string" and (k.kind == "numeric" or k.kind == "datetime") and k.name != target}
    out.data = convert(out.data, typed)
    words = [k.name for k in kinds if k.kind == "categorical" and k.dtype == "string"]
    out.data = unify_spellings(out.data, words)
    out.steps += ["types", "spellings"]
    if target:
        out.data = drop_missing_target(out.data, target)
        out.steps.append("missing target")
    out.data = drop_duplicates(out.data)
    out.steps.append("duplicates")
    gone = [k.name for k in kinds if k.kind in ("constant",) + (("id",) if drop_ids else ()) and k.name != target]
    out.data = out.data.drop(*gone)
    out.steps += [f"dropped {c}" for c in gone]
    numbers = [c for c, t in out.data.dtypes if (t in NUMERIC or t.startswith("decimal")) and c != target]
    if outliers != "none":
        out.data = (clip_outliers if outliers == "clip" else remove_outliers)(out.data, numbers)
        out.steps.append(f"outliers: {outliers}")
    if fill:
        others = [c for c, t in out.data.dtypes if c not in numbers and kind_of_type(t) != "date" and c != target]
        out.data = impute(out.data, numbers, others)
        out.steps.append("filled")
    if encode:
        out.data = one_hot(out.data, [c for c in words if c in out.data.columns and c != target])
        out.steps.append("encoded")
    return out
