"""Table registry: a name and a root folder give a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings search_master bareun_raw dialogue_json "
    "file_meta speakers_normalized sxml tiny_files eval_items mix_targets common_words"
).split()


class Catalog:
    """Tables of one root folder; names with a leading underscore are side files and never tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise KeyError(f"{name} is a protected key")
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def missing_columns(self, name: str, required: list[str]) -> list[str]:
        """Columns that a table should have and lacks; reads no rows."""
        have = set(self.table(name).columns)
        return [c for c in required if c not in have]

    def verdict(self, required: dict[str, list[str]], tolerated: frozenset[str] = frozenset()) -> tuple[bool, dict[str, list[str]]]:
        """(may the build run, missing columns per table); a table that can't be read lacks all. Tolerated tables never block."""
        lacks: dict[str, list[str]] = {}
        for name, columns in required.items():
            try:
                missing = self.missing_columns(name, columns)
            except Exception:  # noqa: BLE001 - whatever keeps the table from being read
                missing = list(columns)
            if missing:
                lacks[name] = missing
        return not set(lacks) - tolerated, lacks
