"""What the operators of this subpackage share: scratch tables, worker set-up and connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: ASCII white space as the contracts define it: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Scratch folders of local sessions without spark.checkpoint.dir.
_OWN: dict[str, str] = {}
#: Rows of a batch at most, between Spark and a Python worker: both hold a batch whole, with its texts.
BATCH = 2000
#: The model that a worker holds, by its operator and what it was made from.
_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The model under key, made if the worker doesn't hold it; a worker holds one, so those of operators before go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def lean(run: Callable) -> Callable:
    """run over batches, after which the worker gives memory back: the allocator else keeps what a task has freed."""

    @functools.wraps(run)
    def task(*batches: Iterator) -> Iterator:
        try:
            yield from run(*batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return task


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package by its path, get batches of BATCH rows at most and give memory back that they no longer need."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH:
        spark.conf.set(size, str(BATCH))
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "1")
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only where it is unset, on a local master, a new folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tabulon-")
        _OWN[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tabulon-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tabulon_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that stored() wrote."""
    path = getattr(df, "_tabulon_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df, stored, with its row number (rank, a long from 0) in the ascending order of columns, nulls first.

    Rows are dealt by ranges, sorted in each and numbered there; a range begins at the number of rows in those before.
    Rows that are equal in all of order are dealt by a running number, so that even a table of copies spreads out.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "__at"]
    dealt = df.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__at")
    table = stored(dealt.withColumn("__id", F.monotonically_increasing_id()), name)
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = table.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # a row for each range
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return table.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + at).drop("__part", "__before", "__id")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars.

    edges holds pairs of longs, in either direction, repeated or not. Returns (node, component) for each node of an
    edge, component being the smallest node reachable. Rows with a null end count for nothing; without edges the result
    is empty. Each round is two grouped minima and two equi-joins over the edges, and is written to the shared folder,
    so nothing is gathered anywhere and a lost executor costs one round at most.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node below all its neighbours keeps its edges to them
        large = large.where("u > v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = stored(small.where("u > v").distinct(), "edges")
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(now)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    star = now.groupBy("u").agg(F.min("v").alias("component"))
    centres = now.select(F.col("v").alias("node")).distinct()
    return star.select(F.col("u").alias("node"), "component").unionByName(centres.select("node", F.col("node").alias("component")))


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text], F.lit(""))
