"""Text expressions that stay on the JVM: white space, tagged strings, packed fields."""

from __future__ import annotations

from collections.abc import Callable
from unicodedata import is_normalized, normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split() knows it, as a Java and RE2 character class body.
WS = r"\s\p{Z}\x0B\x1C\x1D\x1E\x1F\x85"
_WS_CHARS = "".join(chr(x) for x in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Characters without width or ink.
INVISIBLE = (
    r"\p{Cf}\x{0000}-\x{0008}\x{000E}-\x{001B}\x{007F}-\x{0084}\x{0086}-\x{009F}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}"
    r"\x{180B}-\x{180D}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"
)
#: Private marks that never occur in the data: between eojeols, between parts, a quote that is data.
WORD, PART, QUOTE = "\x01", "\x02", ""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_ws(c: Column | str) -> Column:
    """Python's ``str.split()``: no empty items; null gives an empty array."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), f"[{WS}]+"), lambda x: x != "")


def strip_ws(c: Column | str) -> Column:
    """Without white space, byte order marks and zero-width spaces at both ends."""
    return F.btrim(col(c), F.lit(_WS_CHARS + "\ufeff\u200b"))


def compose(x: pa.Array) -> pa.Array:
    """Unicode composition (NFC) of an Arrow array. Python's tables do it: `pyarrow.compute.utf8_normalize` leaves Hangul decomposed."""
    return pa.array([None if t is None else t if is_normalized("NFC", t) else normalize("NFC", t) for t in x.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfc(x: pa.Array) -> pa.Array:
    """Unicode composition (NFC), Arrow batch by batch; the JVM functions of Spark have none."""
    return compose(x)


def rpartition_slash(c: Column | str) -> tuple[Column, Column]:
    """``x.rpartition('/')`` as (left, right); without a slash left is ''."""
    return F.regexp_extract(col(c), r"(?s)^(.*)/([^/]*)$", 1), F.regexp_extract(col(c), r"(?s)^(.*)/([^/]*)$", 2)


def tagged_morphs(tagged: Column | str) -> Column:
    """The plain convention ``m/TAG+m/TAG m/TAG`` as array<array<struct<morph,tag>>>: split on single spaces and ``+``, the last
    slash before the tag, blank eojeols kept as empty arrays so that positions hold, units without a morph dropped."""

    def unit(u: Column) -> Column:
        m, t = rpartition_slash(u)
        return F.struct(m.alias("morph"), t.alias("tag"))

    words = F.split(F.coalesce(col(tagged), F.lit("")), "[ ]")
    return F.transform(words, lambda w: F.filter(F.transform(F.split(w, r"\+"), unit), lambda s: s["morph"] != ""))


def _odd(i: Column) -> Column:
    return i.bitwiseAND(F.lit(1)) == 1


def unquote_field(df: DataFrame, c: str, quote: str) -> DataFrame:
    """Undo the quoting around a whole field or around each of its items: ``"a b"``, ``"a","b"``, ``["a", "b"]``, also with doubled quotes inside.

    The text is split on the quote character. If all even pieces hold only separators and brackets, odd pieces are literals; an
    empty even piece between two of them was a doubled quote and stands for one quote character, any other is a boundary between
    items. Other texts stay as they are. Each step is a column of its own, so that no piece is computed twice.
    """
    df = df.withColumn("_p", F.when(F.col(c).rlike(rf"^\[?[{WS}]*{quote}"), F.split(c, quote)))
    pieces, n = F.col("_p"), F.size("_p")
    df = df.withColumn(
        "_q",
        (n >= 3) & (n.bitwiseAND(F.lit(1)) == 1) & F.forall(F.filter(pieces, lambda p, i: ~_odd(i)), lambda p: p.rlike(r"^[\[\],\s]*$")),
    )
    inner = F.transform(pieces, lambda p, i: F.when(_odd(i), p).when((i == 0) | (i == n - 1), "").when(p == "", quote).otherwise(WORD))
    return df.withColumn(c, F.when(F.col("_q"), F.array_join(inner, "")).otherwise(F.col(c))).drop("_p", "_q")


def split_packed(df: DataFrame, c: str, parts_of: Callable[[Column], Column], even_rules: list[tuple[str, str]], to: str = "words") -> DataFrame:
    """Adds ``to``, an array<array<string>> of a field that packs words of parts under several conventions.

    Field quoting is undone first (`unquote_field`). Then the text is split on double quotes again: odd pieces are literals, in even
    pieces the rules (pattern, replacement) put the marks WORD and PART in place of delimiters; folding the pieces gives one
    string with exact boundaries, which is cut into words and, by `parts_of`, into parts. Words without parts are dropped.
    """

    def rules(p: Column) -> Column:
        for pattern, mark in even_rules:
            p = F.regexp_replace(p, pattern, mark)
        return p

    df = df.withColumn("_s", strip_ws(c))
    df = unquote_field(unquote_field(df, "_s", '"'), "_s", "'")
    # a quote that is itself a morph: it opens a unit and a symbol tag follows at once
    df = df.withColumn("_s", F.regexp_replace("_s", rf'(^|[{WS}{WORD}]|[^"][+＋;])"(/S[A-Z])', rf"$1{QUOTE}$2"))
    folded = F.when(F.instr("_s", '"') == 0, rules(F.col("_s"))).otherwise(
        F.array_join(F.transform(F.split("_s", '"'), lambda p, i: F.when(_odd(i), p).otherwise(rules(p))), "")
    )
    df = df.withColumn("_s", folded)
    words = F.split(F.regexp_replace("_s", QUOTE, '"'), WORD)
    return df.withColumn(to, F.filter(F.transform(words, lambda w: F.filter(parts_of(w), lambda v: v != "")), lambda w: F.size(w) > 0)).drop("_s")


TAGGED_RULES = [
    (rf"(/[A-Z]{{1,5}})[{WS}]*[+＋;][{WS}]*", rf"$1{PART}"),  # a joiner stands after a tag; any other + or ; is a morph
    (rf"(/[A-Z]{{1,5}})[{WS}]*,[{WS}]*", rf"$1{WORD}"),
    (rf"[{WS}|]+(?!/[A-Z]{{2,5}})", WORD),
]
ROMAN_RULES = [(r"[|/;\t\r\n]+", WORD)]


def packed_tagged(df: DataFrame, c: str, to: str = "words") -> DataFrame:
    """Adds the words of ``morph/TAG`` values of a tagged field in any of its conventions."""
    return split_packed(df, c, lambda w: F.transform(F.split(w, PART), strip_ws), TAGGED_RULES, to)


def packed_roman(df: DataFrame, c: str, to: str = "words") -> DataFrame:
    """Adds the words of syllables of a romanized field in any of its conventions; a word without pronunciation gives ``∅``."""

    def syllables(w: Column) -> Column:
        parts = F.transform(F.split(w, r"[_.\-]"), lambda x: F.trim(F.regexp_replace(x, f"[{WS}]+", " ")))
        return F.when(w.rlike(f"^[{WS}]*[∅_-][{WS}]*$"), F.array(F.lit("∅"))).otherwise(parts)

    return split_packed(df, c, syllables, ROMAN_RULES, to)
