"""Frequency dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(weight: str | None) -> Column:
    """How often a row counts: once, or as often as a column of counts says."""
    return F.col(weight) if weight else F.lit(1).cast("bigint")


def frequency(df: DataFrame, keys: list[str], name: str = "freq", weight: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(_n(weight)).alias(name))


def pivot_frequency(df: DataFrame, keys: list[str], by: str, values: list[str], prefix: str = "freq_", weight: str | None = None, *extra: Column) -> DataFrame:
    """One column per listed value and the total of all; the values are given, so there is one pass and no pivot job."""
    n = _n(weight)
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(by) == v, n).otherwise(0)).alias(f"{prefix}{v}") for v in values], F.sum(n).alias(f"{prefix}total"), *extra)


def top_value(df: DataFrame, keys: list[str], value: str, name: str = "top", weight: str | None = None) -> DataFrame:
    """The most frequent value per key with its count; ties go to the smaller value."""
    n = df.groupBy(*keys, value).agg(F.sum(_n(weight)).alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b")
    return n.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{value}").alias(name), F.col("b.n").alias("n"))


def stratified(df: DataFrame, keys: list[str], dims: dict[str, Column], weight: str | None = None) -> DataFrame:
    """(keys, dim, stratum, freq, per_million) over several dimensions in one pass: each row is counted once per dimension, or as often
    as ``weight`` says. The totals of the strata come from the counts, not from the rows again.
    """
    long = df.select(*keys, _n(weight).alias("_n"), F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("stratum")) for d, c in dims.items()])).alias("s")).select(*keys, "_n", "s.*")
    counts = long.groupBy(*keys, "dim", "stratum").agg(F.sum("_n").alias("freq"))
    totals = counts.groupBy("dim", "stratum").agg(F.sum("freq").alias("tokens"))
    return counts.join(totals, ["dim", "stratum"]).select(*keys, "dim", "stratum", "freq", (F.col("freq") / F.col("tokens") * 1e6).alias("per_million"))


def strata_totals(df: DataFrame, dims: dict[str, Column], weight: str | None = None) -> DataFrame:
    long = df.select(_n(weight).alias("_n"), F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("stratum")) for d, c in dims.items()])).alias("s")).select("_n", "s.*")
    return long.groupBy("dim", "stratum").agg(F.sum("_n").alias("tokens"))


def dispersion(df: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """In how many documents each key occurs."""
    return df.groupBy(*keys).agg(F.count_distinct(doc).alias("n_docs"))


def with_share(df: DataFrame, n: str, by: list[str] | None = None, name: str = "share") -> DataFrame:
    """Adds each row's share of the sum of its group, or of all rows. Sums are aggregated and joined back, so no group is collected in one
    task; null keys form a group of their own."""
    by = by or []
    sums = df.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.sum(n).alias("_sum"))
    on = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by]
    j = df.join(sums, on, "left") if by else df.join(F.broadcast(sums))  # one row
    return j.withColumn(name, F.col(n) / F.col("_sum")).select(*df.columns, name)


def norm_table(norms: DataFrame, sources: list[str], main: str) -> DataFrame:
    """Norms of several groups of speakers side by side: (WORD, POS_TAG, COUNT, LOG10, src) to one row per word and tag with a count per
    source, 0 where it has none, and the logarithm of the main source. Counts that are no numbers count as 0."""
    n = F.coalesce(F.col("COUNT").try_cast("double").try_cast("bigint"), F.lit(0))
    counts = [F.sum(F.when(F.col("src") == s, n).otherwise(0)).alias(f"freq_{s}") for s in sources]
    return norms.groupBy(F.col("WORD").alias("word"), F.col("POS_TAG").alias("pos")).agg(*counts, F.max(F.when(F.col("src") == main, F.col("LOG10").try_cast("double"))).alias("log10"))
