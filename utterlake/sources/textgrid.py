"""TextGrid files: a parser into interval rows and writers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.operators.intervals import SILENCE

INTERVALS = "path string, tier string, idx int, xmin double, xmax double, text string"
_NAME = re.compile(r'^\s*name\s*=\s*"((?:[^"]|"")*)"\s*$', re.M)
_CELL = re.compile(r'intervals\s*\[(\d+)\]:?\s*xmin\s*=\s*([-\d.eE]+)\s*xmax\s*=\s*([-\d.eE]+)\s*text\s*=\s*"((?:[^"]|"")*)"')


def parse(text: str) -> Iterator[tuple[str, int, float, float, str]]:
    """(tier, idx, xmin, xmax, text) of a long TextGrid, doubled quotes undone; what is broken off is left out."""
    names = list(_NAME.finditer(text))
    for n, m in enumerate(names):
        end = names[n + 1].start() if n + 1 < len(names) else len(text)
        for c in _CELL.finditer(text, m.end(), end):
            yield m[1].replace('""', '"'), int(c[1]), float(c[2]), float(c[3]), c[4].replace('""', '"')


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
    for b in batches:
        rows = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for r in parse(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "tier", "idx", "xmin", "xmax", "text"])


def intervals(files: DataFrame) -> DataFrame:
    """Interval rows of TextGrids given as (path, content); null and foreign contents give none."""
    return files.select("path", "content").mapInArrow(_rows, INTERVALS)


def read_intervals(spark, folder: str) -> DataFrame:
    """The same from a folder of files, flat or by session."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[Tt]ext[Gg]rid").text(folder, wholetext=True)
    return intervals(f.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def seconds(c: str) -> Column:
    """A time as TextGrids write it, with six decimals."""
    return F.format_string("%.6f", F.col(c).cast("double"))


def rendered(tiers: DataFrame, key: str = "path", order: list[str] | None = None) -> DataFrame:
    """(key, content): interval rows (key, tier, idx, xmin, xmax, text) written as long TextGrids, tiers in the given order or by name."""
    cell = F.format_string('        intervals [%d]:\n            xmin = %s\n            xmax = %s\n            text = "%s"\n', "idx", seconds("xmin"), seconds("xmax"), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')))
    rank = F.coalesce(F.array_position(F.lit(order), F.col("tier")), F.lit(0)) if order else F.lit(0)
    tier = tiers.groupBy(key, "tier").agg(F.array_sort(F.collect_list(F.struct("idx", cell.alias("c")))).alias("cells"), F.min("xmin").alias("b"), F.max("xmax").alias("e")).withColumn("rank", rank)
    body = F.concat(F.lit('        class = "IntervalTier"\n        name = "'), F.replace("tier", F.lit('"'), F.lit('""')), F.lit('"\n        xmin = '), seconds("b"), F.lit("\n        xmax = "), seconds("e"), F.lit("\n        intervals: size = "), F.size("cells").cast("string"), F.lit("\n"), F.array_join(F.transform("cells", lambda x: x["c"]), ""))
    grid = tier.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "tier", body.alias("body")))).alias("t"), F.min("b").alias("b"), F.max("e").alias("e"))
    items = F.array_join(F.transform("t", lambda x, i: F.concat(F.lit("    item ["), (i + 1).cast("string"), F.lit("]:\n"), x["body"])), "")
    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = '), seconds("b"), F.lit("\nxmax = "), seconds("e"), F.lit("\ntiers? <exists>\nsize = "), F.size("t").cast("string"), F.lit("\nitem []:\n"))
    return grid.select(key, F.concat(head, items).alias("content"))


def unpronounced(rows: DataFrame, tier: str = "phones") -> DataFrame:
    """Per file the share of ``spn`` among the labels of a tier that aren't blank."""
    t = F.col("text")
    g = rows.where(F.col("tier") == tier).groupBy("path").agg(F.count_if(t == "spn").alias("spn"), F.count_if(t != "").alias("labels"))
    return g.withColumn("ratio", F.try_divide("spn", "labels"))


def is_silence(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).isin(SILENCE)
