"""Queries over training data by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utterlake.catalog import Catalog
from utterlake.llm import leakage, mixture, quality, terms, turns
from utterlake.llm.sql import SQL
from utterlake.session import new_path


def p2_counts(spark: SparkSession, root: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return terms.marked(terms.count_terms(Catalog(spark, root).bareun_raw, new_path(spark, "terms")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_counts(spark, root).where("mark is not null").select("field", "term", "mark")


def p3_turns(spark: SparkSession, root: str) -> DataFrame:
    """Turns with their clean text; where no label names one, the likely speaker of each utterance parts and joins them."""
    t = Catalog(spark, root)
    return turns.completed_turns(t.search_master, t.dialogue_json, t.file_meta, with_text=True)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    t = Catalog(spark, root)
    return turns.speaker_turns(t.search_master, t.dialogue_json, t.file_meta).select("session_id", "turn_no", "speaker_id", "first_utt_id", "last_utt_id")


def p7_near(spark: SparkSession, root: str) -> DataFrame:
    """Documents with a test passage within two edits in forty characters."""
    t = Catalog(spark, root)
    return leakage.leaks(t.documents, t.eval_items)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_near(spark, root).where("distance = 0").select("doc_id", "item_id")


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(p7_near(spark, root), Catalog(spark, root).eval_items)


def _mixture(spark: SparkSession, root: str) -> mixture.Mixture:
    t = Catalog(spark, root)
    return mixture.Mixture(t.documents, t.mix_targets)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _mixture(spark, root).unreachable()


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mixture(spark, root).shares()


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return _mixture(spark, root).selection()


def p9_quality(spark: SparkSession, root: str) -> DataFrame:
    t = Catalog(spark, root)
    return quality.quality(t.documents, t.common_words)


def p9_stats(spark: SparkSession, root: str) -> DataFrame:
    """The statistics of `p9_quality` that hang on no judgement of lines."""
    return p9_quality(spark, root).select("doc_id", "words", "mean_word_length", "symbol_ratio", "punctuated_share", "common_share")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_quality(spark, root).where("not is_prose").select("doc_id").distinct()


QUERIES = {
    "p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_turns": p3_turns, "p7_found": p7_found, "p7_near": p7_near, "p7_items": p7_items,
    "p8_found": p8_found, "p8_shares": p8_shares, "p8_mixture": p8_mixture, "p9_found": p9_found, "p9_quality": p9_quality, "p9_stats": p9_stats,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
