"""Several values in one field: one value per row with its positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import packed_roman, packed_tagged


def one_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with one row per key. Copies are folded on the map side first; among copies that differ the greatest value that isn't null stays."""
    return df.select(key, value).where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))


def explode_values(df: DataFrame, key: str, words: str, field: str) -> DataFrame:
    """(field, key, word_idx, part_idx, value): one generator over the flattened words, so that a row is walked once."""
    rows = F.flatten(
        F.transform(
            F.col(words),
            lambda w, i: F.transform(w, lambda v, j: F.struct((i + 1).cast("int").alias("word_idx"), (j + 1).cast("int").alias("part_idx"), v.alias("value"))),
        )
    )
    return df.select(F.lit(field).alias("field"), F.col(key), F.inline(rows))


def unpack_values(bareun_raw: DataFrame, search_master: DataFrame) -> DataFrame:
    """Every morph of ``bareun_raw.tagged`` and every syllable of ``search_master.pron_pred_roman``.

    Columns: field, utt_id, word_idx, part_idx, value. word_idx counts the eojeols that hold a value, part_idx the values in the
    eojeol, both from 1. Null and blank fields, and rows without utt_id, give no rows; copies of an utterance count once; deleted
    utterances are included; other columns are never read.
    """
    tagged = explode_values(packed_tagged(one_per_key(bareun_raw, "utt_id", "tagged"), "tagged"), "utt_id", "words", "tagged")
    roman = explode_values(packed_roman(one_per_key(search_master, "utt_id", "pron_pred_roman"), "pron_pred_roman"), "utt_id", "words", "pron_pred_roman")
    return tagged.unionByName(roman)
