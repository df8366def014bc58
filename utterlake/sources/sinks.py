"""Sinks: sorted dictionaries, several tables from one source, partitions rewritten only if they changed, manifests, build reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.operators.search import locate
from utterlake.session import stored


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_dictionary(df: DataFrame, folder: str, order: list, single: bool = False) -> None:
    """A dictionary as CSV in the given order. The sort is by ranges, so files follow each other; ``single`` makes one file of it, for
    dictionaries that one machine is to open."""
    out = df.orderBy(*order)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_tables(source: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> dict[str, int]:
    """Several tables from one source that is computed once: name to the rows written."""
    once, spark = stored(source, "source"), source.sparkSession
    counts = {}
    for name, make in tables.items():
        make(once).write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = spark.read.parquet(f"{folder}/{name}").count()
    return counts


def rewrite_changed(old: DataFrame, new: DataFrame, by: str, folder: str) -> list[str]:
    """Rewrite only those partitions of ``folder`` whose rows differ between two states of a table; returns their names.

    Partitions are compared by count and by two sums of row hashes that don't hang on the order. The new rows are written down first,
    as the old ones may be read from the folder itself.
    """
    cols = sorted(c for c in new.columns if c != by)
    h = F.xxhash64(*cols)
    marks = [F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")]
    a, b = (df.groupBy(F.col(by).cast("string").alias("p")).agg(F.struct(*marks).alias(name)) for df, name in ((old, "a"), (new, "b")))
    changed = [r.p for r in a.join(b, "p", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("p").collect()]  # names of partitions
    spark = new.sparkSession
    rows = stored(new.where(F.coalesce(F.col(by).cast("string"), F.lit("")).isin([p or "" for p in changed])), "changed") if changed else None
    if rows is not None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
        gone = set(changed) - {r.p for r in rows.select(F.col(by).cast("string").alias("p")).distinct().collect()}
        for p in gone:
            fs, path = _fs(spark, f"{folder}/{by}={p}")
            fs.delete(path, True)
    return sorted(changed, key=str)


def manifest(hits: DataFrame, files: DataFrame) -> DataFrame:
    """A hit list with the best file of each utterance (`search.locate`), for those who fetch them."""
    return locate(hits.select("utt_id").where("coalesce(utt_id, '') <> ''").distinct(), files)


def build_report(spark: SparkSession, path: str, checks: DataFrame, must_be_zero: list[str], provenance: dict[str, str]) -> dict:
    """Writes one JSON file with the totals of a build (one row of ``checks``), its verdict and where its inputs come from. The build is
    ``ok`` if every column of must_be_zero is; what fails is named."""
    totals = {k: (v if isinstance(v, int | float | str) or v is None else str(v)) for k, v in checks.first().asDict().items()}
    failed = [c for c in must_be_zero if totals.get(c)]
    report = {"verdict": "ok" if not failed else "failed", "failed": failed, "totals": totals, "provenance": provenance}
    fs, to = _fs(spark, path)
    part = _fs(spark, f"{path}.part")[1]
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(report, ensure_ascii=False, indent=1).encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise RuntimeError(f"{path} can't be committed")
    return report
