"""Delimited text against Python's csv module: line breaks, quotes and encodings anywhere in files that many tasks read."""

import bz2
import csv
import gzip
import io
import lzma
import random
import zipfile

import pytest

from tabulon import api
from tabulon.sources import delimited


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def plain(raw, sep, encoding):
    return [r for r in csv.reader(io.StringIO(raw.decode(encoding).removeprefix("﻿"), newline=""), delimiter=sep) if r]


def table(rng, n, sep, end):
    """A header and n records: a number, a text with anything in it, a last field that may be empty."""
    bits = ["a", "bc", "\n", "\r\n", '""', sep, " ", "é", "5\" x" if sep != ";" else "x", "\n\n"]
    rows = [sep.join(["id", "text", "note"])]
    for k in range(n):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        free = not any(c in text for c in '"\n\r' + sep)
        text = text if free and rng.random() < 0.5 else '"' + text.replace('""', "''").replace('"', '""').replace("''", '""') + '"'
        rows.append(sep.join([str(k), text, rng.choice(["", "n", 'in"ch', '"q"'])]))
        if rng.random() < 0.05:
            rows.append("")
    return end.join(rows) + end


@pytest.mark.parametrize(("sep", "end", "encoding"), [(",", "\n", "utf-8"), (";", "\r\n", "cp1252"), ("\t", "\n", "utf-8-sig"), ("|", "\r\n", "latin-1")])
def test_records_across_splits(small_splits, tmp_path, sep, end, encoding):
    rng = random.Random(sep + end)
    raw = table(rng, 400, sep, end).encode(encoding)
    if encoding == "latin-1":
        raw = raw.replace(b"\xe9", b"\x81")
    (tmp_path / "x.csv").write_bytes(raw)
    lines = delimited.text_lines(small_splits, str(tmp_path / "x.csv"))
    assert lines.select("block").distinct().count() > 10
    found = delimited.facts(lines)
    assert delimited.encoding_of(found) == encoding.removesuffix("-sig")
    assert delimited.spans_lines(lines, sep)
    df = api.load(small_splits, str(tmp_path / "x.csv"))
    want = plain(raw, sep, encoding)
    assert df.columns == want[0] and df.dtypes[0][1] == "int"
    got = sorted((str(r["id"]), r["text"] or "", r["note"] or "") for r in df.collect())
    assert got == sorted(map(tuple, want[1:]))
    assert df.rdd.getNumPartitions() > 1


def test_a_record_longer_than_splits(small_splits, tmp_path):
    long = "\n".join(f'line {k}, ""{k}""' for k in range(300))
    (tmp_path / "x.csv").write_text(f'a,b\n1,"{long}"\n2,x\n3,"{long}"')
    got = {r["a"]: r["b"] for r in api.load(small_splits, str(tmp_path / "x.csv")).collect()}
    assert got == {1: long.replace('""', '"'), 2: "x", 3: long.replace('""', '"')}
    (tmp_path / "open.csv").write_text(f'a,b\n1,x\n2,"{long}')  # never closed
    assert api.load(small_splits, str(tmp_path / "open.csv")).count() == 2


def test_late_breaks_and_letters(spark, tmp_path):
    """The first line break in quotes and the first letter that isn't UTF-8 stand behind 64 KB."""
    rows = ["id,name", *(f"{k},plain {k}" for k in range(8000)), '8000,"two\nlines"', "8001,café"]
    (tmp_path / "x.csv").write_bytes("\n".join(rows).encode("cp1252"))
    df = api.load(spark, str(tmp_path / "x.csv"))
    assert df.count() == 8002 and df.dtypes[0] == ("id", "int")
    assert {r["name"] for r in df.where("id >= 8000").collect()} == {"two\nlines", "café"}


@pytest.mark.parametrize("packing", ["gz", "bz2", "zip", "xz"])
def test_packed_files(spark, tmp_path, packing):
    raw = 'id;name\n1;"a\nb"\n2;naïve\n'.encode("cp1252")
    path = tmp_path / f"x.csv.{packing}"
    if packing == "zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("x.csv", raw)
    else:
        path.write_bytes({"gz": gzip, "bz2": bz2, "xz": lzma}[packing].compress(raw))
    df = api.load(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [(1, "a\nb"), (2, "naïve")] and df.dtypes == [("id", "int"), ("name", "string")]


def test_without_breaks_spark_reads(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('nåme,"q,x"\n1,"a ""b"""\n2,"5"" x"\n'.encode("cp1252"))
    df = api.load(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["nåme", "q,x"] and sorted(r[1] for r in df.collect()) == ['5" x', 'a "b"']
    assert "FileScan csv" in df._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "mac.csv").write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    assert sorted(map(tuple, api.load(spark, str(tmp_path / "mac.csv")).collect())) == [(1, "x\ry"), (2, "z")]


def test_columns_that_lines_lack(spark, tmp_path):
    """Short and long lines, a column without a value, two files of a folder with a header each."""
    (tmp_path / "d.csv").mkdir()
    (tmp_path / "d.csv" / "1.csv").write_text('a,,c\n1,2\n"x\ny",2,3,4\n')
    (tmp_path / "d.csv" / "2.csv").write_text("a,,c\n5,,\n")
    df = api.load(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["a", "_c1", "c"] and sorted(map(tuple, df.collect())) == [("1", 2, None), ("5", None, None), ("x\ny", 2, 3)]
