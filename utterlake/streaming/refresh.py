"""Incremental refresh: files that arrive are processed once, then the job ends; event-time windows for live streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refresh(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet", glob: str | None = None) -> int:
    """Process all files of ``source`` (whose names match ``glob``) that no earlier call has seen and write the result under ``sink``; returns the number of batches.

    The checkpoint remembers the files. A batch owns one folder of the sink and overwrites it when it runs again, so a job that was
    killed leaves nothing doubled. What isn't finished stays invisible.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done.append(number)

    reader = spark.readStream.schema(schema).format(fmt)
    stream = (reader.option("pathGlobFilter", glob) if glob else reader).load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def new_keys(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet: the resume of a batch job without a checkpoint."""
    return batch.join(done.select(key), key, "left_anti")


def windowed_counts(stream: DataFrame, at: str, by: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts per event-time window (tumbling, or sliding with ``slide``); rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size, slide or size).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of activity that end after a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")
