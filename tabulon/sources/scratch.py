"""Tables that a read or an operator writes in between, in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of local sessions without spark.checkpoint.dir.
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master that has none a new folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tabulon-"))
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: it is computed once, and its lineage ends there."""
    path = f"{scratch_dir(df.sparkSession)}/tabulon-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
