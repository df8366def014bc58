"""Queries over the corpus tables and their SQL: nested annotation, packed fields, orphan references, file consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utterlake.catalog import Catalog
from utterlake.operators import compact, nested, orphans, packed


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return nested.flatten_links(Catalog(spark, root).sxml)


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    t = Catalog(spark, root)
    return orphans.orphan_report(t.search_master, t.bareun_raw, t.file_meta, t.speakers_normalized)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_report(spark, root).select("ref_field", "row_key", "state")


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_counts(p4_report(spark, root))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return compact.consolidated(Catalog(spark, root).tiny_files).select("layer", "utt_id", "path")


def p5_bins(spark: SparkSession, root: str) -> DataFrame:
    return compact.bin_report(Catalog(spark, root).tiny_files)


def p5_files(spark: SparkSession, root: str) -> DataFrame:
    """The files as written, with their sizes."""
    return compact.file_report(Catalog(spark, root).tiny_files)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    t = Catalog(spark, root)
    return packed.unpack_values(t.bareun_raw, t.search_master)


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_bins": p5_bins, "p5_files": p5_files, "p6_found": p6_found}
