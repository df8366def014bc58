"""Frequency of every term, kept by signed deltas in persistent, partitioned counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.functions.text import INVISIBLE, nfc, packed_tagged, split_ws
from utterlake.operators.counts import SignedCounts, halfway, loaded_between

RECORDS = "#records"  # the field under which the number of records itself is counted, with term ''
STORE_SCHEMA = "field string, term string, occurrences bigint, records bigint"


def form_terms(c: Column) -> Column:
    """Eojeols: composed, case kept, without invisible characters, without punctuation and symbols at both ends."""
    ends = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"
    return F.filter(F.transform(split_ws(c), lambda w: F.regexp_replace(w, ends, "")), lambda w: w != "")


def utterance_records(bareun_raw: DataFrame) -> DataFrame:
    """One record per utterance (utt_id, form, tagged), deleted ones included; copies agree, of unequal ones the greatest value stays."""
    return bareun_raw.where("utt_id is not null").groupBy("utt_id").agg(F.max("form").alias("form"), F.max("tagged").alias("tagged"))


def record_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed records (utt_id, form, tagged, sign) that lead from one snapshot to another: only added, changed and deleted ones."""
    cols = ["utt_id", "form", "tagged"]
    o, n = old.select(*[F.col(c).alias(f"o_{c}") for c in cols]), new.select(*[F.col(c).alias(f"n_{c}") for c in cols])
    both = o.join(n, F.col("o_utt_id") == F.col("n_utt_id"), "full").where(
        F.col("o_utt_id").isNull() | F.col("n_utt_id").isNull() | ~F.col("o_form").eqNullSafe(F.col("n_form")) | ~F.col("o_tagged").eqNullSafe(F.col("n_tagged"))
    )
    side = lambda p, sign: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in cols], F.lit(sign).alias("sign"))
    return both.select(F.explode(F.array(side("o", -1), side("n", 1))).alias("r")).select("r.*").where("utt_id is not null")


def changes_between(bareun_raw: DataFrame, after: object | None, until: object | None) -> DataFrame:
    """Signed records that lead from the utterances loaded until one time to those loaded until another (null: from nothing, to the end).

    Only utterances with a row loaded in between are looked at: an utterance that is new comes in, one whose record differs goes out as
    it was and comes in as it is. Rows without a load time count as loaded first.
    """
    if after is None:
        return utterance_records(bareun_raw if until is None else loaded_between(bareun_raw, None, until)).withColumn("sign", F.lit(1))
    fresh = loaded_between(bareun_raw, after, until).where("utt_id is not null").select("utt_id").distinct()
    known = F.coalesce(F.col("loaded_at").cast("timestamp") <= F.lit(after), F.lit(True))
    rows = bareun_raw if until is None else loaded_between(bareun_raw, None, until)
    both = rows.join(fresh, "utt_id", "left_semi").groupBy("utt_id").agg(
        F.bool_or(known).alias("old"), *[F.max(F.when(known, F.col(c))).alias(f"o_{c}") for c in ("form", "tagged")], *[F.max(c).alias(f"n_{c}") for c in ("form", "tagged")]
    )
    both = both.where(~F.col("old") | ~F.col("o_form").eqNullSafe(F.col("n_form")) | ~F.col("o_tagged").eqNullSafe(F.col("n_tagged")))
    side = lambda p, sign: F.struct(F.col(f"{p}_form").alias("form"), F.col(f"{p}_tagged").alias("tagged"), F.lit(sign).alias("sign"))
    return both.select("utt_id", F.inline(F.when(F.col("old"), F.array(side("o", -1), side("n", 1))).otherwise(F.array(side("n", 1)))))


def term_deltas(records: DataFrame) -> DataFrame:
    """(field, term, occurrences, records): the change that signed records make; without ``sign`` all are added.

    A record's terms are sorted, so the first of each run of equal terms counts the record and all count the occurrences: one pass,
    one aggregation that is combined before the shuffle, however long a record or however frequent a term.
    """
    sign = F.col("sign").cast("bigint") if "sign" in records.columns else F.lit(1).cast("bigint")
    df = records.select(sign.alias("_sign"), nfc(F.regexp_replace("form", f"[{INVISIBLE}]+", "")).alias("_form"), "tagged")
    df = packed_tagged(df, "tagged", "_words").withColumn("_morphs", F.array_sort(F.flatten("_words"))).withColumn("_eojeols", F.array_sort(form_terms(F.col("_form"))))

    def runs(name: str, field: str) -> Column:
        first = lambda t, i: F.when((i > 0) & (F.get(name, i - 1) == t), 0).otherwise(1)
        return F.coalesce(F.transform(F.col(name), lambda t, i: F.struct(F.lit(field).alias("field"), t.alias("term"), F.lit(1).alias("o"), first(t, i).alias("r"))), F.array())

    record = F.array(F.struct(F.lit(RECORDS).alias("field"), F.lit("").alias("term"), F.lit(1).alias("o"), F.lit(1).alias("r")))
    terms = df.select("_sign", F.inline(F.concat(record, runs("_eojeols", "form"), runs("_morphs", "tagged"))))
    return terms.groupBy("field", "term").agg(F.sum(F.col("_sign") * F.col("o")).alias("occurrences"), F.sum(F.col("_sign") * F.col("r")).alias("records"))


class TermCounts(SignedCounts):
    """The counts of terms at ``path`` (`SignedCounts`): a delta costs its own size, a repeated one is harmless."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, STORE_SCHEMA, ["field", "term"])


def marked(counts: DataFrame, rare_records: int = 1, common_share: float = 0.02) -> DataFrame:
    """Adds ``mark``: ``rare`` for terms in at most rare_records records, ``common`` for terms in more than common_share of all
    records, else null. A term that is both (in a tiny collection) counts as rare."""
    n = (counts.where(F.col("field") == RECORDS).first() or {"records": 0})["records"]
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * n, "common")
    return counts.where(F.col("field") != RECORDS).withColumn("mark", mark)


def count_terms(bareun_raw: DataFrame, path: str, until: list | None = None) -> DataFrame:
    """Counts of all terms of the utterances, through a store at ``path``; null and empty fields have no terms.

    The table is taken in as changes, one delta per time in ``until`` (null takes the rest); by default in two, before and after the
    middle of the load times. A step of the same name isn't taken twice, so a job that starts again goes on where it stood.
    """
    store = TermCounts(bareun_raw.sparkSession, path)
    if until is None:
        middle = halfway(bareun_raw) if "loaded_at" in bareun_raw.columns else None
        until = [middle, None] if middle else [None]
    after = None
    for step in until:
        store.apply(term_deltas(changes_between(bareun_raw, after, step)), f"{after}..{step}")
        after = step
    return store.read()
