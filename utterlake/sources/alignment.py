"""Alignment databases (SQLite) as DataFrames: tables read by ranges of row ids, the labels and utterances of their intervals."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.operators.intervals import SILENCE

_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True, timeout=120)


def read_table(spark: SparkSession, path: str, table: str, schema: str, rows_per_task: int = 1_000_000, where: str = "1 = 1") -> DataFrame:
    """A table of a database file that all executors can open. Tasks read ranges of row ids, so only the bounds are asked by the driver;
    rows come in batches. ``where`` is applied by the database."""
    fields = [f.split() for f in schema.split(", ")]
    names, target = ", ".join(f'"{n}"' for n, _ in fields), pa.schema([(n, _ARROW[t]) for n, t in fields])
    with _open(path) as con:
        lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    starts = [] if lo is None else list(range(lo, hi + 1, rows_per_task))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                con = _open(path)
                got = con.execute(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ? AND ({where})', (start, start + rows_per_task))
                while rows := got.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
                con.close()

    ranges = spark.createDataFrame([(s,) for s in starts], "start bigint")
    return ranges.repartition(max(1, len(starts))).mapInArrow(read, schema)


def utterance_files(utterance: DataFrame, file: DataFrame, speaker: DataFrame | None = None) -> DataFrame:
    """Utterances (id, file_id, speaker_id, begin, end, …) with the name of their file and, where there is one, of their speaker; rows
    without a file leave."""
    j = utterance.join(file.select(F.col("id").alias("file_id"), F.col("name").alias("file")), "file_id")
    if speaker is not None:
        j = j.join(speaker.select(F.col("id").alias("speaker_id"), F.col("name").alias("speaker")), "speaker_id", "left")
    return j


def labelled_intervals(intervals: DataFrame, labels: DataFrame, label_id: str, label: str) -> DataFrame:
    """Intervals (utterance_id, begin, end, label_id) with the text of their label: unknown ids and silences are ''."""
    j = intervals.join(labels.select(F.col("id").alias(label_id), F.col(label).alias("text")), label_id, "left")
    text = F.coalesce("text", F.lit(""))
    return j.select("utterance_id", F.col("begin").alias("xmin"), F.col("end").alias("xmax"), F.when(text.isin(SILENCE), "").otherwise(text).alias("text"))
