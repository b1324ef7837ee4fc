"""Streams: incremental ingest of files, windowed counts, sessions and running links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """``column`` as a timestamp with a watermark: NTZ timestamps, which can't carry one, are taken in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling_counts(df: DataFrame, column: str, size: str, keys: Sequence[str] = (), slide: str | None = None, *aggregates: Column) -> DataFrame:
    """Counts in tumbling (with ``slide`` sliding) windows; works on batches and on streams."""
    window = F.window(column, size, slide) if slide else F.window(column, size)
    out = df.groupBy(window.alias("_w"), *keys).agg(F.count("*").alias("n"), *aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(df: DataFrame, column: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Sessions of events no further apart than ``gap``; works on batches and on streams."""
    out = df.groupBy(F.session_window(column, gap).alias("_s"), *keys).agg(F.count("*").alias("n"), *aggregates)
    return out.select(F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), *[c for c in out.columns if c != "_s"])


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], transform: Callable[[DataFrame], DataFrame] | None = None, within: tuple[str, str] | None = None):
    """Appends a stream's rows of new keys to a Parquet table: a rerun after a failure adds nothing twice. Returns the running query.

    Keys that were seen are the stream's state, dealt out by their hash and kept with the
    checkpoint, so that a batch reads its own rows and the state of their keys, never the
    table.  What the table holds from elsewhere isn't known to it.  State grows with the
    keys, unless ``within`` (event time, delay) lets it forget keys older than the delay:
    then a key that returns later is new.  ``transform`` applies to the stream.  The
    batch's number is part of the folder that it writes to, so that a repeated batch
    overwrites itself; the state goes back to before it, too.
    """
    out = transform(stream) if transform else stream
    out = with_event_time(out, *within).dropDuplicatesWithinWatermark(list(keys)) if within else out.dropDuplicates(list(keys))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
