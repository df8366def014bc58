"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utterlake.plans import corpus, corpus_sql, frequency, frequency_sql, layers, layers_sql, tiers, tiers_sql

MODULES = [corpus, frequency, layers, tiers]
SQL_MODULES = [corpus_sql, frequency_sql, layers_sql, tiers_sql]


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return layers.flagship(spark, root)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in SQL_MODULES for name, sql in m.SQL.items()}
