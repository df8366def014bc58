"""Scores against a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_matches(gold: DataFrame, ours: DataFrame, key: str, item: str, place: str | None = None) -> DataFrame:
    """Per key: gold, ours and common items as multisets (common is the sum of the smaller counts). Keys of the gold that ours has too.

    With ``place``, a column of both that orders the items of a key, also whether both are the same sequence (``same``). Both sides meet
    in one aggregation per key and item, combined before the shuffle.
    """
    at = F.col(place) if place else F.lit(0)
    side = lambda df, g: df.select(key, item, at.alias("_at"), F.lit(g).cast("bigint").alias("g"), F.lit(1 - g).cast("bigint").alias("o"))
    both = side(gold, 1).unionByName(side(ours, 0))
    # a key's sequences agree if every place holds one item of either side and both are equal: sums of a hash of place and item cancel out
    mark = F.xxhash64("_at", item).cast("decimal(20,0)")
    counts = both.groupBy(key, item).agg(F.sum("g").alias("g"), F.sum("o").alias("o"), F.sum(F.when(F.col("g") == 1, mark).otherwise(-mark)).alias("d"))
    per = counts.groupBy(key).agg(F.sum("g").alias("gold"), F.sum("o").alias("ours"), F.sum(F.least("g", "o")).alias("tp"), F.sum(F.abs("d")).alias("_d"))
    per = per.where("gold > 0 and ours > 0")
    return per.select(key, "gold", "ours", "tp", *([(F.col("_d") == 0).alias("same")] if place else []))


def micro_prf(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one per value of ``by`` and one over all): precision, recall and F1 (0 where undefined), the keys that match exactly as
    multisets and, if the matches say so (``same``), as sequences."""
    sequence = [F.count_if("same").alias("sequences")] if "same" in matches.columns else []
    g = matches.rollup(*by) if by else matches.groupBy()
    s = g.agg(F.sum("gold").alias("gold"), F.sum("ours").alias("ours"), F.sum("tp").alias("tp"), F.count("*").alias("keys"), F.count_if((F.col("gold") == F.col("tp")) & (F.col("ours") == F.col("tp"))).alias("exact"), *sequence)
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp"), F.col("ours")), div(F.col("tp"), F.col("gold"))
    return s.select(*(by or []), "gold", "ours", "tp", "keys", "exact", *(["sequences"] if sequence else []), p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"))


def accuracy_by(df: DataFrame, method: str, correct: str) -> DataFrame:
    """Items and correct ones by method (less what stands in brackets), and in total (method null)."""
    return df.withColumn("method", F.substring_index(method, "(", 1)).rollup("method").agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("ok"))


def mismatch_sample(df: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """The first mismatches in a stated order, as a report."""
    return df.orderBy(*order).limit(n)
