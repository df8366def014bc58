"""Which records have their files, which still lack them, and summaries per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_presence(df: DataFrame, key: str, **inventories: DataFrame) -> DataFrame:
    """A flag per inventory (a table with the key): whether the record is in it."""
    for name, inv in inventories.items():
        df = df.join(inv.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return df


def coverage_summary(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """both / only a / only b / neither, with a total row (by is null) from one rollup."""
    x, y = F.col(a), F.col(b)
    return df.rollup(*by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias(f"{a}_only"), F.count_if(~x & y).alias(f"{b}_only"), F.count_if(~x & ~y).alias("neither"), F.count("*").alias("n"))


def still_missing(failed: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    return failed.join(recovered.select(key), key, "left_anti")


def recovery(df: DataFrame, failed: Column, recovered: Column, by: str) -> DataFrame:
    """failed, recovered, left and rate per group and in total."""
    g = df.rollup(by).agg(F.count_if(failed).alias("failed"), F.count_if(failed & recovered).alias("recovered"))
    return g.withColumn("left", F.col("failed") - F.col("recovered")).withColumn("rate", F.try_divide(F.col("recovered"), F.col("failed")))


def length_class(seconds: Column, short: float = 0.3) -> Column:
    """short below 0.3 s, normal, or absent."""
    return F.when(seconds.isNull(), "absent").when(seconds < short, "short").otherwise("normal")
