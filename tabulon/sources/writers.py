"""Writing tables and results."""

from __future__ import annotations

import datetime
import json
import math
import re
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> str:
    """df as parquet, orc, json lines, csv or tsv by path's extension; xlsx for small results. single: one file, by one task."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "csv"
    if kind in ("xlsx", "xlsm"):
        write_sheet(df, path)
        return path
    out = (df.coalesce(1) if single else df).write.mode(mode)
    if kind in ("parquet", "orc"):
        out.format(kind).save(path)
    elif kind in ("json", "jsonl", "ndjson"):
        out.json(path, ignoreNullFields=False)
    else:
        out.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return path


def append(df: DataFrame, path: str) -> str:
    """More rows for a table, with the types that it has."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).schema
    except Exception:  # noqa: BLE001  nothing there yet
        have = df.schema
    df.select(*[F.col(f.name).cast(f.dataType) for f in have.fields]).write.mode("append").parquet(path)
    return path


def write_sheet(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small result as the one sheet of an xlsx file; an error if it has more than most rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a sheet takes at most {most} rows; write parquet or csv")

    def cell(v: object) -> str:
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    name = lambda k: (name(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    body = []
    for r, row in enumerate([df.columns, *rows], 1):
        cells = [re.sub("^<c", f'<c r="{name(k)}{r}"', cell(v)) for k, v in enumerate(row)]
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')


def plain(value: object) -> object:
    """A value that JSON can hold: numbers that aren't finite are null, dates are text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, str):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_json(value: object, path: str | Path) -> None:
    Path(path).write_text(json.dumps(plain(value), indent=2, ensure_ascii=False), encoding="utf-8")


def fingerprint(df: DataFrame) -> str:
    """16 hex digits of a table's columns and rows in any order, by one aggregation."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    import hashlib

    return hashlib.sha256(repr((df.dtypes, row["n"], row["x"], int(row["s"]))).encode()).hexdigest()[:16]
