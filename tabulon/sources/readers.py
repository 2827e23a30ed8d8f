"""Reading tables: by extension, database URL or DataFrame."""

from __future__ import annotations

import io
import lzma
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tabulon.sources import delimited

#: Extension to format; .gz and .bz2 are read by Spark itself, .zip and .xz are unpacked in executors.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".txt": "txt", ".parquet": "parquet", ".pq": "parquet", ".feather": "feather", ".arrow": "feather", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "excel", ".xlsm": "excel", ".orc": "orc"}
PACKED = (".gz", ".bz2", ".zip", ".xz")
DATABASES = ("sqlite", "duckdb", "postgresql", "postgres", "mysql", "mariadb", "mssql", "oracle")


class SourceError(ValueError):
    """A table that can't be read as asked."""


def format_of(source: str) -> tuple[str, str]:
    """(format, packing) of a path or URL."""
    path = re.sub(r"[?#].*$", "", source).lower()
    packing = next((p for p in PACKED if path.endswith(p)), "")
    bare = path[: len(path) - len(packing)] if packing else path
    found = next((f for ext, f in FORMATS.items() if bare.endswith(ext)), None)
    if found is None:
        raise SourceError(f"can't tell the format of {source!r}; known are {', '.join(FORMATS)}")
    return found, packing


def _unpacked(spark: SparkSession, path: str, packing: str, fmt: str) -> DataFrame:
    """Tables in .zip and .xz files, unpacked where they are read; one task for each file, as neither kind can be split."""

    def lines(batches: Iterator) -> Iterator:
        import pandas as pd

        for part in batches:
            for file, raw in zip(part["path"], part["content"], strict=True):
                if packing == ".xz":
                    data = lzma.decompress(raw)
                else:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        data = z.read(z.namelist()[0])
                yield pd.DataFrame({"file": file, "block": 0, "value": data.removesuffix(b"\n").split(b"\n")})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "file string, block long, value binary")
    if fmt in ("json", "jsonl"):
        text = rows.select("file", F.decode("value", "UTF-8").alias("value")).withColumn("value", F.replace("value", F.lit("\ufeff")))
        if fmt == "json":
            text = text.groupBy("file").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
        strings = getattr(text.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(spark._jsparkSession.read().json(strings), spark)
    shown = rows.withColumn("value", F.col("value").cast("string"))
    top = b"\n".join(bytes(r["value"]) for r in rows.limit(200).collect())[: delimited.HEAD]
    sep = "\t" if fmt == "tsv" or fmt == "txt" and b"\t" in top[:4096] else delimited.delimiter_of(top)
    return delimited.read_lines(shown, sep, delimited.facts(shown))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or one record a line."""
    first = delimited.head_bytes(spark, path, 64).lstrip(b"\xef\xbb\xbf \t\r\n")
    return spark.read.option("multiLine", first.startswith(b"[")).json(path)


# --- Excel and Feather as data sources


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheets(raw: bytes) -> dict[str, list[list[object]]]:
    """The rows of each sheet of an xlsx file."""
    out: dict[str, list[list[object]]] = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for sheet, file in zip(book.iter(f"{{{_NS['m']}}}sheet"), files, strict=False):
            rows = []
            for row in ElementTree.fromstring(z.read(file)).iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, object] = {}
                for c in row:
                    ref = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                    at = 0
                    for letter in ref:
                        at = at * 26 + ord(letter) - 64
                    v, kind = c.find("m:v", _NS), c.get("t", "n")
                    text = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) or None
                    if text is not None:
                        cells[at - 1] = shared[int(text)] if kind == "s" else bool(int(text)) if kind == "b" else text if kind in ("inlineStr", "str") else float(text)
                rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
            out[sheet.get("name")] = [r for r in rows if any(v is not None for v in r)]
    return out


class SheetSource(DataSource):
    """One sheet of an xlsx file: spark.read.format("tabulon_sheet").option("path", …).option("sheet", name or index)."""

    @classmethod
    def name(cls) -> str:
        return "tabulon_sheet"

    def _rows(self) -> list[list[object]]:
        found = sheets(Path(self.options["path"]).read_bytes())
        wanted = self.options.get("sheet")
        if wanted is None:
            return max(found.values(), key=len)
        if wanted in found:
            return found[wanted]
        if wanted.isdigit() and int(wanted) < len(found):
            return list(found.values())[int(wanted)]
        raise SourceError(f"no sheet {wanted!r}; there are {', '.join(found)}")

    def schema(self) -> StructType:
        head, *rows = self._rows()
        kinds = []
        for k in range(len(head)):
            values = [r[k] for r in rows if k < len(r) and r[k] is not None]
            number = bool(values) and all(isinstance(v, float) for v in values)
            kinds.append(LongType() if number and all(v.is_integer() for v in values) else DoubleType() if number else StringType())
        return StructType([StructField(str(h or f"column_{k}"), t) for k, (h, t) in enumerate(zip(head, kinds, strict=True))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SheetReader(self._rows()[1:], schema)


class _SheetReader(DataSourceReader):
    def __init__(self, rows: list[list[object]], schema: StructType) -> None:
        self.rows, self.kinds = rows, [f.dataType for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(0, max(1, len(self.rows)), 10_000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in self.rows[partition.value : partition.value + 10_000]:
            padded = [*row, *[None] * (len(self.kinds) - len(row))]
            yield tuple(None if v is None else int(v) if isinstance(t, LongType) else float(v) if isinstance(t, DoubleType) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v, t in zip(padded, self.kinds, strict=True))


class FeatherSource(DataSource):
    """An Arrow IPC file, one partition for each record batch."""

    @classmethod
    def name(cls) -> str:
        return "tabulon_feather"

    def schema(self) -> StructType:
        import pyarrow.ipc as ipc
        from pyspark.sql.pandas.types import from_arrow_schema

        with ipc.open_file(self.options["path"]) as f:
            return from_arrow_schema(f.schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeatherReader(self.options["path"])


class _FeatherReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import pyarrow.ipc as ipc

        with ipc.open_file(self.path) as f:
            return [InputPartition(k) for k in range(f.num_record_batches)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow.ipc as ipc

        with ipc.open_file(self.path) as f:
            yield f.get_batch(partition.value)


def read_database(spark: SparkSession, url: str, query: str | None, table: str | None) -> DataFrame:
    """A query's result or a table. SQLite and DuckDB files are read through their Python modules, others by JDBC."""
    if not (query or table):
        raise SourceError("a database needs query= or table=")
    scheme = url.split(":", 1)[0].split("+")[0].lower()
    sql = query or f"SELECT * FROM {table}"
    if scheme in ("sqlite", "duckdb"):
        path = re.sub(r"^\w+:/*", "/" if re.match(r"^\w+:////", url) else "", url)
        if scheme == "sqlite":
            import pandas as pd

            with sqlite3.connect(path) as con:
                return spark.createDataFrame(pd.read_sql_query(sql, con))
        import duckdb

        with duckdb.connect(path, read_only=True) as con:
            return spark.createDataFrame(con.execute(sql).df())
    kind = {"postgres": "postgresql", "mssql": "sqlserver"}.get(scheme, scheme)
    return spark.read.format("jdbc").option("url", f"jdbc:{kind}:{url.split(':', 1)[1]}").option("query", sql).load()


def load(spark: SparkSession, source: str | DataFrame, *, sheet: str | int | None = None, query: str | None = None, table: str | None = None, sample: float | None = None, seed: int = 42, engine: str = "auto") -> DataFrame:
    """A table from a path, URL, database URL or DataFrame. engine is accepted and has no effect: Spark splits large files itself."""
    if isinstance(source, DataFrame):
        df = source
    elif source.split(":", 1)[0].split("+")[0].lower() in DATABASES and ":" in source:
        df = read_database(spark, source, query, table)
    else:
        if re.match(r"https?://", source):
            spark.sparkContext.addFile(source)
            source = "file://" + __import__("pyspark").SparkFiles.get(source.rsplit("/", 1)[-1])
        fmt, packing = format_of(source)
        if packing in (".zip", ".xz"):
            df = _unpacked(spark, source, packing, fmt)
        elif fmt in ("csv", "txt"):
            df = delimited.read_delimited(spark, source, "\t" if fmt == "txt" and b"\t" in delimited.head_bytes(spark, source, 4096) else None)
        elif fmt == "tsv":
            df = delimited.read_delimited(spark, source, "\t")
        elif fmt == "json":
            df = read_json(spark, source)
        elif fmt == "jsonl":
            df = spark.read.json(source)
        elif fmt in ("excel", "feather"):
            spark.dataSource.register(SheetSource if fmt == "excel" else FeatherSource)
            reader = spark.read.format("tabulon_sheet" if fmt == "excel" else "tabulon_feather").option("path", re.sub("^file:/*", "/", source))
            df = (reader.option("sheet", str(sheet)) if sheet is not None else reader).load()
        else:
            df = spark.read.format(fmt).load(source)
    if len(set(df.columns)) < len(df.columns):
        raise SourceError("column names repeat")
    if not df.columns or df.isEmpty():
        raise SourceError("the table is empty")
    if sample:
        from tabulon.operators.splits import sample as take

        df = take(df, sample, seed=seed)
    return df


def describe(source: str) -> str:
    """A source without passwords."""
    return re.sub(r"(://[^:/@]+):[^@]*@", r"\1:***@", source) if "://" in source else source


def stem(source: str) -> str:
    """A short name for a source."""
    name = re.sub(r"[?#].*$", "", source).rstrip("/").rsplit("/", 1)[-1]
    while (cut := name.rpartition("."))[0] and "." + cut[2].lower() in (*FORMATS, *PACKED):
        name = cut[0]
    return name or "data"
