"""Frequency dictionaries beside the norms of other corpora and a lexicon.

Each norm is cut to one row per key first, then all meet in a chain of left joins that never fans out; what a norm lacks counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.hangul import ipa_map
from utterlake.functions.text import split_ws

#: Fixed value: how a norm writes that it has no romanization.
NO_ROMAN = ["", "[ - ]"]


def split_counts(norm: DataFrame, keys: list[str], name: str, spoken: str, roman: str = "roman", mfa: str = "mfa") -> DataFrame:
    """norm (keys, corpus_type, freq, roman, mfa) to one row per key: ``{name}_spoken`` and ``{name}_written``, and the romanizations of its
    smallest row that has one. Counts that are no numbers count as 0; rows with a null or blank key are left out."""
    n = F.coalesce(F.col("freq").cast("string").try_cast("bigint"), F.lit(0))
    is_spoken = F.coalesce(F.col("corpus_type") == spoken, F.lit(False))
    has = ~F.coalesce(roman, F.lit("")).isin(NO_ROMAN)
    pair = F.struct(F.col(roman).alias("r"), F.coalesce(mfa, F.lit("")).alias("m"))
    g = norm
    for k in keys:
        g = g.where(F.coalesce(k, F.lit("")) != "")
    g = g.groupBy(*keys).agg(F.sum(F.when(is_spoken, n).otherwise(0)).alias(f"{name}_spoken"), F.sum(F.when(is_spoken, 0).otherwise(n)).alias(f"{name}_written"), F.min(F.when(has, pair)).alias("_p"))
    return g.select(*keys, f"{name}_spoken", f"{name}_written", F.coalesce("_p.r", F.lit("")).alias(f"{name}_roman"), F.coalesce("_p.m", F.lit("")).alias(f"{name}_mfa"))


def lexicon_entries(lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lexicon (word, pos, word_type, origin, roman, mfa) to (word, lex_roman, lex_mfa) and (word, pos, etym_type, etym_origin).

    A word's romanization is its smallest; a kind of origin that differs between senses is written ``혼합(a|b)``; of the origins the
    first three in order are kept.
    """
    from utterlake.operators.sense import etymology

    pair = F.struct(F.col("roman").alias("r"), F.coalesce("mfa", F.lit("")).alias("m"))
    named = lexicon.where("coalesce(word, '') <> ''")
    roman = named.where("coalesce(roman, '') <> ''").groupBy("word").agg(F.min(pair).alias("p")).select("word", F.col("p.r").alias("lex_roman"), F.col("p.m").alias("lex_mfa"))
    known = named.where("coalesce(trim(pos), '') <> '' and coalesce(trim(word_type), '') <> ''")
    kind, origins = etymology(F.collect_set(F.trim("word_type")), F.collect_set(F.trim(F.coalesce("origin", F.lit("")))))
    etym = known.groupBy("word", F.trim("pos").alias("pos")).agg(kind.alias("etym_type"), origins.alias("etym_origin"))
    return roman, etym


def chain(df: DataFrame, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins with tables of one row per key; missing numbers become 0, missing texts ''."""
    for t, keys in tables:
        df = df.join(t, keys, "left")
        numbers = [c for c, kind in t.dtypes if c not in keys and kind in ("bigint", "int")]
        df = df.fillna(0, numbers) if numbers else df
        texts = [c for c, kind in t.dtypes if c not in keys and kind == "string"]
        df = df.fillna("", texts) if texts else df
    return df


def roman_chain(first: str, second: str, last: str | None = None) -> tuple[Column, Column]:
    """(roman, mfa) by fallback: each from the first norm, else the second; without a romanization both come from the lexicon."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    roman = F.coalesce(filled(f"{first}_roman"), filled(f"{second}_roman"), F.lit(""))
    mfa = F.coalesce(filled(f"{first}_mfa"), filled(f"{second}_mfa"), F.lit(""))
    if last is None:
        return roman, mfa
    return F.when(roman != "", roman).otherwise(F.col(f"{last}_roman")), F.when(roman != "", mfa).otherwise(F.col(f"{last}_mfa"))


def mfa_to_ipa(mfa: Column, table: dict[str, str] | None = None) -> Column:
    """IPA of ``G EO - S EU``: sounds joined, ``.`` between syllables, an unknown sound as ``⟨x⟩``; '' for nothing."""
    known = F.create_map(*[F.lit(x) for kv in (table or ipa_map()).items() for x in kv])
    sound = lambda t: F.coalesce(F.try_element_at(known, t), F.concat(F.lit("⟨"), t, F.lit("⟩")))
    syllables = F.filter(F.transform(F.split(mfa, "-"), lambda s: F.array_join(F.transform(split_ws(s), sound), "")), lambda s: s != "")
    return F.when(F.coalesce(F.trim(mfa), F.lit("")).isin(*NO_ROMAN, "-"), "").otherwise(F.array_join(syllables, "."))
