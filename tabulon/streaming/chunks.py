"""Incremental runs: scoring of arriving files and resampling of arriving events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """Files of a folder as a stream of small batches, with the schema of like."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def score_stream(source: DataFrame, predict: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, first: Callable[[DataFrame], None] | None = None):  # noqa: ANN201
    """Score each batch and append it to a Parquet table; first looks at the first batch (for drift, or missing columns)."""

    def batch(df: DataFrame, number: int) -> None:
        if number == 0 and first is not None:
            first(df)
        predict(df).write.mode("append").parquet(out)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resample(source: DataFrame, ts: str, value: str, window: str = "1 day", late: str = "1 day", group: list[str] = ()) -> DataFrame:
    """(group, ts, n, total, mean) of tumbling windows; for a stream, events later than late are left out."""
    events = source.withWatermark(ts, late) if source.isStreaming else source
    out = events.groupBy(*group, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(*group, F.col("w.start").alias("ts"), "n", "total", "mean")


def write_table(source: DataFrame, path: str, checkpoint: str, mode: str = "append"):  # noqa: ANN201
    return source.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
