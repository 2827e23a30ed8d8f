"""Delimited text whose quotes, line breaks and encoding are known for the whole file, read by many tasks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tabulon.sources.scratch import stored

#: Bytes by which a delimiter is judged.
HEAD = 65_536
#: Kinds of rows that a split reports: a whole record, the beginning of one, the end of one, part of one, its end states.
WHOLE, HEAD_OF, TAIL_OF, MIDDLE_OF, ENDS = range(5)
EITHER = 2
_PARTS = "file string, block long, began int, seq long, kind int, text string"


def head_bytes(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The beginning of a file, unpacked if it is .gz or .bz2, or of a folder's first one, wherever Spark can read it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if fs.getFileStatus(where).isDirectory():
        files = sorted(str(f.getPath()) for f in fs.listStatus(where) if not str(f.getPath().getName()).startswith(("_", ".")))
        return head_bytes(spark, files[0], size) if files else b""
    stream = fs.open(where)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = codec.createInputStream(stream) if codec is not None else stream
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def delimiter_of(raw: bytes) -> str:
    """The comma, unless it makes one column of the first line and another mark makes more."""
    text = raw.decode("utf-8", "replace").removeprefix("\ufeff")
    first = next((r for r in csv.reader(io.StringIO(text, newline="")) if r), [])
    if len(first) > 1:
        return ","
    try:
        return csv.Sniffer().sniff(text, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def text_lines(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """The bytes of each line (value), in the order of each split of a file: file, block, value."""
    return spark.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


# --- what is in a file


def facts(lines: DataFrame) -> dict[str, int]:
    """Counts over all lines: lines, files, quoted (those with a quote), those that aren't UTF-8 and aren't Windows-1252, cr (those with a lone carriage return)."""
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    valid = F.is_valid_utf8("value")
    count = lambda c: F.count(F.when(c, 1))
    return lines.agg(
        F.count("*").alias("lines"),
        F.count_distinct("file").alias("files"),
        count(F.contains("value", F.lit('"'))).alias("quoted"),
        count(~valid).alias("not_utf8"),
        # bytes that the code page leaves open
        count(~valid & F.rlike(text, F.lit(r"[\x81\x8D\x8F\x90\x9D]"))).alias("not_cp1252"),
        count(F.instr("value", "\r").between(F.lit(1), F.length("value") - 1)).alias("cr"),
    ).first().asDict()


def encoding_of(found: dict[str, int]) -> str:
    """UTF-8 if all bytes are, else Windows-1252 if all bytes are, else Latin-1."""
    return "utf-8" if not found["not_utf8"] else "cp1252" if not found["not_cp1252"] else "latin-1"


# --- records


def open_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is open at the end of a line, if one is (inside) or isn't at its beginning.

    A quote opens a field only as its first character; within it, two quotes are one; what follows a closing quote up to
    the delimiter is part of the field, quotes included.
    """
    at = 0
    if not inside:
        if line.startswith(b'"'):
            inside, at = True, 1
        else:
            at = line.find(sep + b'"')
            if at < 0:
                return False
            inside, at = True, at + len(sep) + 1
    while True:
        end = line.find(b'"', at)
        while end >= 0 and line[end + 1 : end + 2] == b'"':
            end = line.find(b'"', end + 2)
        if end < 0:
            return True
        # outside again: the next field that begins with a quote
        at = line.find(sep, end + 1)
        if at < 0:
            return False
        if line[at + len(sep) : at + len(sep) + 1] == b'"':
            at += len(sep) + 1
        else:
            at = line.find(sep + b'"', at)
            if at < 0:
                return False
            at += len(sep) + 1


class _Reading:
    """Lines of one split, read as if a quoted field were open at its beginning (inside) or not."""

    def __init__(self, inside: bool) -> None:
        self.inside = self.leading = inside
        self.parts: list[bytes] = []

    def feed(self, line: bytes, sep: bytes) -> tuple[int, list[bytes]] | None:
        """The record that ends with this line, if one does: (WHOLE or TAIL_OF, its lines)."""
        if b'"' in line:
            self.inside = open_after(line, self.inside, sep)
        if self.inside:
            self.parts.append(line)
            return None
        done = (TAIL_OF if self.leading else WHOLE, [*self.parts, line])
        self.parts, self.leading = [], False
        return done

    def rest(self) -> tuple[int, list[bytes]] | None:
        return (MIDDLE_OF if self.leading else HEAD_OF, self.parts) if self.inside else None


def _split_reader(sep: bytes, encoding: str, line_sep: bytes, ends_only: bool):  # noqa: ANN202
    """Read lines under both states; ENDS rows say how each would end: seq has twice the end without an open field at the
    beginning, plus the end with one. Records that both states have in common are reported once, as of EITHER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: tuple[str, int] | None = None
        states: list[_Reading] = []
        seq = spans = 0
        started = False  # whether the file's first record has been seen

        def place() -> int:
            """-1 for the first record of a file, else the line's number in its split."""
            nonlocal started
            first, started = now is not None and not now[1] and not started, True
            return -1 if first else seq

        def text(parts: list[bytes], kind: int) -> str:
            raw = line_sep.join(parts)
            if kind in (WHOLE, TAIL_OF) and raw.endswith(b"\r"):
                raw = raw[:-1]
            return raw.decode(encoding)

        def close() -> None:
            if now is None:
                return
            ends = [s.inside for s in states] if len(states) == 2 else [states[0].inside] * 2
            for began, s in enumerate(states):
                left = s.rest()
                if left and not ends_only:
                    rows.append((*now, began if len(states) == 2 else EITHER, place(), left[0], text(left[1], left[0])))
            rows.append((*now, int(spans > 0 or states[0].inside), 2 * ends[0] + ends[1], ENDS, None))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "block", "began", "seq", "kind", "text"])
            rows.clear()
            return out

        for part in batches:
            for file, block, line in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, block) != now:
                    close()
                    now, states, seq, spans, started = (file, block), [_Reading(False), _Reading(True)], 0, 0, False
                    if not block:
                        line, states = line.removeprefix(b"\xef\xbb\xbf"), [_Reading(False)]
                for began, s in enumerate(states):
                    done = s.feed(line, sep)
                    if done is None:
                        continue
                    spans += not began and len(done[1]) > 1
                    if not ends_only and (len(done[1]) > 1 or done[1][0] not in (b"", b"\r") or done[0] == TAIL_OF):
                        rows.append((file, block, began if len(states) == 2 else EITHER, place(), done[0], text(done[1], done[0])))
                seq += 1
                if len(states) == 2 and not states[0].inside and not states[1].inside:
                    states = states[:1]
            if len(rows) >= 2048:
                yield batch()
        close()
        yield batch()

    return run


def _started(ends: DataFrame) -> DataFrame:
    """file, block, start: whether a quoted field is open at the beginning of each split, by a prefix scan over its file's.

    A split sends either state to one; those that send both to the same settle it, and from there on each split that
    swaps them turns it round. A row for each split takes part.
    """
    one, two = F.shiftright("seq", 1), F.col("seq") % 2
    by = Window.partitionBy("file").orderBy("block")
    rows = ends.select("file", "block", F.when(one == two, one).alias("settled"), F.when((one == 1) & (two == 0), 1).otherwise(0).alias("turns"))
    rows = rows.withColumn("g", F.count("settled").over(by))
    within = Window.partitionBy("file", "g").orderBy("block")
    end = (F.coalesce(F.max("settled").over(within), F.lit(0)) + F.sum("turns").over(within)) % 2
    return rows.withColumn("end", end).select("file", "block", F.coalesce(F.lag("end").over(by), F.lit(0)).cast("int").alias("start"))


def spans_lines(lines: DataFrame, sep: str) -> bool:
    """Whether a quoted field holds a line break anywhere."""
    ends = lines.withColumn("value", F.col("value").cast("binary")).mapInArrow(_split_reader(sep.encode(), "latin-1", b"\n", True), _PARTS)
    # while none does, each split begins outside
    return bool(ends.where("began = 1").limit(1).count())


def records(lines: DataFrame, sep: str, encoding: str = "utf-8", line_sep: str = "\n") -> DataFrame:
    """The records of files (text), quoted line breaks included: file, first (whether it is a file's first), text.

    Each split of a file is read once, under either state that it may begin in, and what it has to say is written to the
    shared folder; the records under the state that didn't hold are dropped by a join with the states, a row a split.
    A record that goes over the ends of splits is put together from their parts, of which a split has two at most.
    """
    told = stored(lines.withColumn("value", F.col("value").cast("binary")).mapInArrow(_split_reader(sep.encode(), encoding, line_sep.encode(), False), _PARTS), "records")
    starts = _started(told.where(F.col("kind") == ENDS)).withColumnsRenamed({"file": "__file", "block": "__block"})
    held = told.where(F.col("kind") != ENDS).join(starts, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    held = held.where((F.col("began") == EITHER) | (F.col("began") == F.col("start"))).withColumn("first", F.col("seq") == -1)
    parts = held.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("record", F.count(F.when(F.col("kind") == HEAD_OF, 1)).over(order))
    joined = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("p"), F.max("first").alias("first"))
    joined = joined.select("file", "first", F.array_join(F.col("p")["text"], line_sep).alias("text"))
    return held.where(F.col("kind") == WHOLE).select("file", "first", "text").unionByName(joined)


def parse(rows: DataFrame, sep: str, header: bool = True) -> DataFrame:
    """A table from records (text, first): types are inferred over all of them, names are the first record's of a file."""
    spark = rows.sparkSession
    top = rows.where("first").agg(F.min_by("text", "file")).first()[0]
    if top is None:
        return spark.createDataFrame([], StructType([]))
    cells = next(csv.reader(io.StringIO(top, newline=""), delimiter=sep))
    names = [c if c else f"_c{k}" for k, c in enumerate(cells)] if header else [f"_c{k}" for k in range(len(cells))]
    texts = rows.where("not first").select("text") if header else rows.select("text")
    strings = lambda df: getattr(df._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = lambda: spark._jsparkSession.read().option("sep", sep).option("escape", '"').option("multiLine", "true")
    # a row of empty fields says how many there are
    wide = spark.createDataFrame([(sep.join(['""'] * len(names)),)], "text string")
    inferred = reader().option("inferSchema", "true").csv(strings(wide.unionByName(texts))).schema()
    kinds = StructType.fromJson(__import__("json").loads(inferred.json()))
    schema = StructType([StructField(n, f.dataType if str(f.dataType) != "NullType()" else StringType(), True) for n, f in zip(names, kinds.fields, strict=True)])
    unnamed = StructType([StructField(f"_c{k}", f.dataType, True) for k, f in enumerate(schema.fields)])
    java = spark._jsparkSession.parseDataType(unnamed.json())
    return DataFrame(reader().schema(java).csv(strings(texts)), spark).toDF(*names)


def read_lines(lines: DataFrame, sep: str, found: dict[str, int], line_sep: str = "\n") -> DataFrame:
    """A table from lines (file, block, value), in the encoding that facts() tell."""
    return parse(records(lines, sep, encoding_of(found), line_sep), sep)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, multiline: bool | None = None) -> DataFrame:
    """Delimited text with a header, .gz and .bz2 included.

    The delimiter is sniffed on the first 64 KB if the comma makes one column. The encoding (UTF-8, else Windows-1252,
    else Latin-1) and whether quoted fields hold line breaks (or say so by multiline) are judged by all bytes. Without
    such fields the file is Spark's own reader's; with them its splits are read by records().
    """
    sep = sep or delimiter_of(head_bytes(spark, path))
    line_sep, lines = "\n", text_lines(spark, path)
    found = facts(lines)
    if found["cr"] and found["lines"] == found["files"]:  # no line feed anywhere
        line_sep, lines = "\r", text_lines(spark, path, "\r")
        found = facts(lines)
    encoding = encoding_of(found)
    if multiline is None:
        multiline = bool(found["quoted"]) and spans_lines(lines, sep)
    if multiline:
        return read_lines(lines, sep, found, line_sep)
    reader = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').option("sep", sep)
    if encoding != "cp1252" or spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "true":
        return reader.option("encoding", {"utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}[encoding]).csv(path)
    # the charset isn't among those that readers take, and differs from Latin-1 in 27 code points
    out = reader.option("encoding", "ISO-8859-1").csv(path)
    marks = "".join(chr(k) for k in range(0x80, 0xA0) if bytes([k]).decode("cp1252", "ignore"))
    named = lambda x: F.translate(x, marks, "".join(bytes([ord(m)]).decode("cp1252") for m in marks))
    out = out.withColumns({c: named(F.col(f"`{c}`")) for c, t in out.dtypes if t == "string"})
    shown = str.maketrans({m: bytes([ord(m)]).decode("cp1252") for m in marks})
    return out.withColumnsRenamed({c: c.translate(shown) for c in out.columns})
