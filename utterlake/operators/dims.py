"""Dimension tables with explicit first-wins and last-wins semantics, joins with defaults, fallback chains, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import col

UNKNOWN = "미상"
#: Levels of education in ascending order, and a spelling of the source that is mended.
EDUCATION = ["초졸 이하", "중졸", "고졸", "대재", "대졸", "대학원 이상"]
OCCUPATION_TYPO = {"기술자 종자사(장치/기계 조작 및 조립 종사자)": "기술자 종사자(장치/기계 조작 및 조립 종사자)"}


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``. One aggregation that is combined before the shuffle, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def gathered(key: str, **sources: tuple[DataFrame, list[str]]) -> DataFrame:
    """(key, a struct per source): the last row of each key in several tables, name=(table, order), null where a table has none.

    All tables meet as one union under one aggregation, combined before the shuffle, so it takes one exchange however many there are and
    no join. A struct begins with the columns of its order; ties go to the greater values of the rest.
    """
    kinds = {n: df.select(F.struct(*order, *[c for c in df.columns if c != key and c not in order]).alias("r")).schema["r"].dataType for n, (df, order) in sources.items()}
    parts = []
    for name, (df, order) in sources.items():
        own = F.struct(*order, *[c for c in df.columns if c != key and c not in order])
        parts.append(df.where(F.col(key).isNotNull()).select(key, *[(own if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in sources]))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(*[F.max(n).alias(n) for n in sources])


def join_with_defaults(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object], blank_is_missing: bool = True) -> DataFrame:
    """Left outer join to a table of one row per key. A miss gives the default; so does an empty text, unless blanks are kept (a null
    is then ''). Adds nothing else, never fans out."""
    if blank_is_missing:
        j = left.join(right.select(*keys, *defaults), keys, "left")
        fill = lambda c, d: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.lit(d)).alias(c)
    else:
        j = left.join(right.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in defaults]), keys, "left")
        fill = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return j.select(*left.columns, *[fill(c, d) for c, d in defaults.items()])


def first_filled(*cols: Column) -> Column:
    """A fallback chain: the first value that is neither null nor ''."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


def or_unknown(c: Column | str) -> Column:
    """Trimmed; ``미상`` for null, '' and NA."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(t.isin("", "NA"), UNKNOWN).otherwise(t)


def age_group(c: Column | str) -> Column:
    """The sixties are named like the open class above them; all other classes stay."""
    v = or_unknown(c)
    return F.when(v == "60대", "60대 이상").otherwise(v)


def occupation(c: Column | str) -> Column:
    v = or_unknown(c)
    for wrong, right in OCCUPATION_TYPO.items():
        v = F.when(v == wrong, right).otherwise(v)
    return v


def education_rank(c: Column | str) -> Column:
    """1 for the lowest level; '' for an unknown one."""
    at = F.array_position(F.lit(EDUCATION), F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(at > 0, at.cast("string")).otherwise("")


def category(c: Column | str) -> Column:
    """``a > b > c`` without white space inside the parts and without empty parts."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ">"), lambda p: F.regexp_replace(p, r"\s+", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), " > ")


def register(c: Column | str) -> Column:
    """``b - c`` of a category of three parts or more, b without 대화; else the compact category or ``미상``."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ">"), lambda p: F.regexp_replace(p, r"\s+", "")), lambda p: p != "")
    three = F.concat(F.replace(F.get(parts, 1), F.lit("대화"), F.lit("")), F.lit("-"), F.get(parts, 2))
    joined = F.array_join(parts, ">")
    return F.when(F.size(parts) >= 3, three).when(joined == "", UNKNOWN).otherwise(joined)


def discourse_mode(c: Column | str) -> Column:
    """From the last part of the category: 독백, 대화 or ``미상``."""
    leaf = F.element_at(F.split(category(c), " > "), -1)
    return F.when(leaf == "", UNKNOWN).when(leaf == "독백", "독백").otherwise("대화")
