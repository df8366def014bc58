"""Tokens of forms and tagged strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import col, packed_tagged, rpartition_slash, split_ws


def morph_positions(df: DataFrame, key: str = "utt_id", tagged: str = "tagged") -> DataFrame:
    """(key, word_idx, morph_idx, morph, tag), positions from 1. Words are cut at single spaces, so a blank word takes a position; a unit
    without a morph before its last slash takes one too but gives no row. Null and empty strings give no rows."""
    words = df.where(F.col(tagged).isNotNull() & (F.col(tagged) != "")).select(key, F.posexplode(F.split(tagged, "[ ]")).alias("w", "word"))
    units = words.select(key, (F.col("w") + 1).alias("word_idx"), F.posexplode(F.split("word", r"\+")).alias("m", "unit"))
    morph, tag = rpartition_slash("unit")
    return units.select(key, "word_idx", (F.col("m") + 1).alias("morph_idx"), morph.alias("morph"), tag.alias("tag")).where("morph <> ''")


def packed_positions(df: DataFrame, keep: list[str], tagged: str = "tagged") -> DataFrame:
    """(keep…, word_idx, morph_idx, morph, tag) of a tagged field in any of its conventions: one generator over the flattened words, so
    a row is walked once. Positions count eojeols and morphs that aren't empty, from 1. Null and blank fields give no rows."""
    words = packed_tagged(df.select(*keep, tagged), tagged, "_words")
    rows = F.flatten(F.transform("_words", lambda w, i: F.transform(w, lambda v, j: F.struct((i + 1).cast("int").alias("word_idx"), (j + 1).cast("int").alias("morph_idx"), v.alias("_v")))))
    morph, tag = rpartition_slash("_v")
    return words.select(*keep, F.inline(rows)).select(*keep, "word_idx", "morph_idx", morph.alias("morph"), tag.alias("tag"))


def packed_pairs(df: DataFrame, form: str = "form", tagged: str = "tagged", keep: list[str] | None = None) -> DataFrame:
    """(keep…, surface, analysis) of records whose form has as many words as their analysis, in any of its conventions; an analysis is written
    ``m/TAG+m/TAG``."""
    pairs = packed_tagged(df.select(*(keep or []), form, tagged), tagged, "_words").withColumn("_f", split_ws(form)).where((F.size("_words") > 0) & (F.size("_f") == F.size("_words")))
    plain = F.transform("_words", lambda w: F.array_join(w, "+"))
    return pairs.select(*(keep or []), F.inline(F.arrays_zip(F.col("_f").alias("surface"), plain.alias("analysis"))))


def eojeol_pairs(df: DataFrame, form: str = "form", tagged: str = "tagged") -> DataFrame:
    """(surface, analysis) of records whose form has as many words as their analysis."""
    pairs = df.where(F.coalesce(tagged, F.lit("")) != "").withColumn("_f", split_ws(form)).withColumn("_t", F.split(tagged, "[ ]"))
    return pairs.where(F.size("_f") == F.size("_t")).select(F.inline(F.arrays_zip(F.col("_f").alias("surface"), F.col("_t").alias("analysis"))))


def form_to_lab(form: Column | str) -> Column:
    """Hangul runs of each word; words without any are dropped."""
    return F.array_join(F.filter(F.transform(split_ws(form), lambda w: F.regexp_replace(w, "[^가-힣]", "")), lambda w: w != ""), " ")


def form_to_clean_lab(form: Column | str) -> Column:
    """Words that are Hangul throughout, without their end punctuation; mixed words are dropped whole."""
    words = F.transform(split_ws(form), lambda w: F.regexp_replace(w, r"""[.,?!~…"']""", ""))
    return F.array_join(F.filter(words, lambda w: w.rlike("^[가-힣]+$")), " ")


def tagged_to_lab(tagged: Column | str) -> Column:
    """Surfaces of the morphs of each word but those whose tag begins with S."""

    def word(w: Column) -> Column:
        units = F.filter(F.split(w, r"\+"), lambda u: ~F.regexp_extract(u, "/([^/]*)$", 1).startswith("S"))
        return F.array_join(F.transform(units, lambda u: F.regexp_extract(u, "(?s)^(.*)/([^/]*)$", 1)), "")

    return F.array_join(F.filter(F.transform(F.split(F.coalesce(col(tagged), F.lit("")), "[ ]"), word), lambda w: w != ""), " ")


def packed_lab(words: Column) -> Column:
    """`tagged_to_lab` of words already split into ``morph/TAG`` values."""
    morph, tag = (lambda v: rpartition_slash(v)[0]), (lambda v: rpartition_slash(v)[1])
    word = lambda w: F.array_join(F.transform(F.filter(w, lambda v: ~tag(v).startswith("S")), morph), "")
    return F.array_join(F.filter(F.transform(words, word), lambda w: w != ""), " ")


def session_of(utt_id: Column | str) -> Column:
    return F.substring_index(col(utt_id), ".", 1)


def year_of(utt_id: Column | str) -> Column:
    """``20`` + the two digits after the four letters of the session, null where they aren't digits."""
    two = F.substring(session_of(utt_id), 5, 2)
    return F.when(two.rlike("^[0-9]{2}$"), F.concat(F.lit("20"), two))


def sequence_of(utt_id: Column | str) -> Column:
    """The last part of an id, '' if it has one part only."""
    parts = F.split(col(utt_id), r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def numeric_order(utt_id: Column | str) -> Column:
    """The parts after the session as numbers: sorts utterances as spoken, not as spelled."""
    return F.transform(F.slice(F.split(col(utt_id), r"\."), 2, 99), lambda x: x.try_cast("int"))
