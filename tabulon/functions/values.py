"""Column functions: coercion, placeholders, dates, category text and small parsers."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean a missing value, in lower case.
MISSING = ("", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "?", "-", "--", "---", "missing", "#n/a", "#na", "undefined", "unknown", "not available", ".")
#: Marks that may stand in a number written as text.
NUMBER_MARKS = r"[,\s$€£¥₹%]"
#: Date formats that are tried; on a tie the earlier one wins, so month-first before day-first.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "MM/dd/yyyy HH:mm", "dd/MM/yyyy HH:mm", "MMM d yyyy", "d MMM yyyy", "yyyyMMdd")


class ColumnError(ValueError):
    """A column that can't be found, with the nearest name."""


def resolve(name: str, columns: list[str]) -> str:
    """The column meant by name: itself, else the only one equal but for case and spaces."""
    if name in columns:
        return name
    fold = lambda s: re.sub(r"\s+", "", s).lower()
    same = [c for c in columns if fold(c) == fold(name)]
    if len(same) == 1:
        return same[0]
    near = difflib.get_close_matches(name, columns, 1)
    raise ColumnError(f"no column {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))


def resolve_all(names: list[str], columns: list[str]) -> list[str]:
    return [resolve(n, columns) for n in names]


def number(c: Column) -> Column:
    """Text to double: currency, percent and thousands marks go, parentheses make negative, anything else gives null."""
    bare = F.regexp_replace(c.cast("string"), NUMBER_MARKS, "")
    return F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast("double")


def cleaned_text(c: Column) -> Column:
    """Trimmed text, null where it only says that the value is missing."""
    bare = F.trim(c)
    return F.when(F.lower(bare).isin(*MISSING), F.lit(None)).otherwise(bare)


def number_or_null(c: Column) -> Column:
    """NaN as null, which is how missing numbers are kept here."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def category(c: Column, kind: str) -> Column:
    """Category text in which 1, 1.0 and '1' are equal and booleans read True and False."""
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    if kind in ("double", "float") or kind.startswith("decimal"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(F.trim(c.cast("string")))
    return F.trim(c.cast("string"))


def category_number_text(c: Column) -> Column:
    """Category text of text: whole numbers lose their decimals."""
    bare = F.trim(c)
    return F.when(bare.rlike(r"^-?[0-9]{1,15}\.0+$"), F.regexp_extract(bare, r"^(-?[0-9]+)", 1)).otherwise(bare)


def guess_date_format(df: DataFrame, column: str, share: float = 0.9, formats: tuple[str, ...] = DATE_FORMATS) -> str | None:
    """The format that parses the most values, if it parses share of them; one aggregation for all formats."""
    tries = [F.avg(F.try_to_timestamp(F.col(column), F.lit(f)).isNotNull().cast("double")).alias(f"f{k}") for k, f in enumerate(formats)]
    row = df.where(F.col(column).isNotNull()).agg(*tries).first()
    rates = [row[f"f{k}"] or 0.0 for k in range(len(formats))]
    best = max(range(len(formats)), key=lambda k: (rates[k], -k))
    return formats[best] if rates[best] >= share else None


def date(c: Column, fmt: str) -> Column:
    """Text to a timestamp without zone; values with an offset are taken to UTC, which the session's zone must be."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def date_parts(c: Column, prefix: str = "") -> list[Column]:
    """year, month, day, dayofweek (Monday 0), hour and is_weekend."""
    day = F.weekday(c)
    parts = {"year": F.year(c), "month": F.month(c), "day": F.day(c), "dayofweek": day, "hour": F.hour(c), "is_weekend": (day >= 5).cast("int")}
    return [v.cast("int").alias(prefix + k) for k, v in parts.items()]


def calendar_parts(c: Column, unit: str) -> list[Column]:
    """What a model of a series gets of its dates, for an hourly, daily, weekly, monthly, quarterly or yearly series."""
    hour, day = F.hour(c).alias("hour"), F.weekday(c).alias("weekday")
    month, doy = F.month(c).alias("month"), F.dayofyear(c).alias("dayofyear")
    by_unit = {"hour": [hour, day, month, doy], "day": [day, month, doy], "week": [F.weekofyear(c).alias("week"), month], "month": [month, F.quarter(c).alias("quarter")], "quarter": [F.quarter(c).alias("quarter")], "year": []}
    return by_unit[unit]


#: Words that say that a column identifies rows, as its whole name, as the first and as the last word of it.
ID_NAMES = ("id", "uuid", "guid", "index", "key", "rowid")
ID_FIRST = ("id", "uuid", "guid")
ID_LAST = ("id", "uuid", "guid", "key", "number", "no")


def name_words(name: str) -> list[str]:
    """The words of a column's name, between blanks, dots, dashes and underscores."""
    for mark in "_.-":
        name = name.replace(mark, " ")
    return name.split()


def looks_like_id(name: str) -> bool:
    """Whether a column's name says that it identifies rows; without other marks a word can end in a capital I: orderId."""
    words = name_words(name)
    if not words:
        return False
    low = [w.lower() for w in words]
    if low[0].startswith("unnamed:"):  # what readers call a column without a header
        return True
    last = words[-1]
    if len(last) > 2 and low[-1].endswith("id") and last[-2] == "I" and last[-3].islower():
        return True
    if len(low) == 1:
        return low[0] in ID_NAMES
    return low[0] in ID_FIRST or low[-1] in ID_LAST


def parse_share(value: object) -> float | None:
    """'auto' or None, '2%' or 0.02: a share between 0 and 0.5."""
    text = str(value).strip().lower()
    if value is None or text == "auto":
        return None
    try:
        share = float(text.rstrip("%")) / (100 if text.endswith("%") else 1)
    except ValueError:
        raise ValueError(f"a share like 0.02, 2% or auto is needed, not {value!r}") from None
    if not 0 < share < 0.5:
        raise ValueError("a share lies between 0 and 0.5")
    return share


def parse_range(value: object, low: int = 2, high: int = 10) -> range:
    """'auto', '4' or '2-8': numbers of groups to try."""
    text = str(value or "auto").strip().lower()
    if text == "auto":
        return range(low, high + 1)
    found = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", text)
    if not found or int(found[1]) < 2 or found[2] and int(found[2]) < int(found[1]):
        raise ValueError(f"groups are given as 4, 2-8 or auto, not {value!r}")
    return range(int(found[1]), int(found[2] or found[1]) + 1)


def parse_seconds(text: str) -> float:
    """'90', '90s', '5m', '2h', '1h30m' as seconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([smhd]?)", text.strip().lower())
    if not parts or "".join(a + b for a, b in parts) != re.sub(r"\s+", "", text.strip().lower()):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[b] for a, b in parts)


def show_number(x: float | None) -> str:
    if x is None or x != x:
        return "-"
    if float(x).is_integer() and abs(x) < 1e15:
        return f"{int(x):,}"
    return f"{x:,.2f}" if abs(x) >= 100 else f"{x:.4g}"


def show_share(x: float, digits: int = 1) -> str:
    return f"{100 * x:.{digits}f}%"


def show_seconds(x: float) -> str:
    return f"{x:.1f}s" if x < 60 else f"{int(x // 60)}m {int(x % 60)}s" if x < 3600 else f"{int(x // 3600)}h {int(x % 3600 // 60)}m"


def score(c: Column, digits: int = 4) -> Column:
    """Rounded half to even, as reported scores are."""
    return F.bround(c, digits)
