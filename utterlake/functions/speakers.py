"""Speaker labels and times as transcribers write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import WS, col

_WIDE = "０１２３４５６７８９ＳＤＰＫ"
_NARROW = "0123456789SDPK"
#: What transcribers write for "no speaker" and "no time".
NO_LABEL = ["", "NA", "N/A", "NULL", "NONE", "NAN", "UNKNOWN", "미상", "-", "?"]


def clean_label(c: Column | str) -> Column:
    """A label without width variants, brackets, white space and trailing colon, in upper case; '' for no label."""
    t = F.upper(F.translate(F.coalesce(col(c), F.lit("")), _WIDE, _NARROW))
    t = F.regexp_replace(t, rf"[{WS}\x{{FEFF}}\x{{200B}}\[\](){{}}<>:：;,._\-#]+", "")
    return F.when(t.isin([x.replace("-", "").replace("/", "/") for x in NO_LABEL]), "").otherwise(t)


def label_number(clean: Column) -> Column:
    """The number of a label that only numbers the speakers of a session (화자 1, P1, SPK_01, 1), else null."""
    n = F.regexp_extract(clean, r"^(?:화자|참여자|참가자|SPEAKER|SPKR|SPK|SP|S|P)?0*([1-9][0-9]{0,3})$", 1)
    return F.when(n != "", F.try_to_number(n, F.lit("9999")).cast("int"))


def resolve_label(clean: Column, number: Column, speaker_ids: Column) -> Column:
    """The speaker's id: an id as it is, a number counted along ``speaker_ids`` ('|' between ids), '' for no label.

    A number beyond the list, or in a session without a list, stays a label of that session (``#2``): it still parts the speakers.
    """
    listed = F.btrim(F.get(F.split(speaker_ids, r"\|"), number - 1))
    return F.when(number.isNull(), clean).otherwise(F.coalesce(F.when(listed != "", listed), F.concat(F.lit("#"), number.cast("string"))))


def is_known(speaker: Column) -> Column:
    """Whether the speaker is an id, so that it refers to a row elsewhere."""
    return (speaker != "") & ~speaker.startswith("#")


def session_speakers(file_meta: DataFrame) -> DataFrame:
    """(session_id, speaker_ids): one row per file, deleted ones too; of unequal lists the greatest stays."""
    return file_meta.where(F.col("file_id").isNotNull()).groupBy(F.col("file_id").alias("session_id")).agg(F.max("speaker_ids").alias("speaker_ids"))


def with_speaker(utterances: DataFrame, file_meta: DataFrame, label: str = "speaker_id", to: str = "speaker") -> DataFrame:
    """Adds the resolved speaker. Only rows whose label is a number meet the session list, so the bulk isn't shuffled."""
    u = utterances.withColumn("_clean", clean_label(label)).withColumn("_number", label_number(F.col("_clean")))
    plain = u.where("_number is null").withColumn(to, F.col("_clean"))
    numbered = u.where("_number is not null").join(session_speakers(file_meta), "session_id", "left")
    numbered = numbered.withColumn(to, resolve_label(F.col("_clean"), F.col("_number"), F.col("speaker_ids"))).drop("speaker_ids")
    return plain.unionByName(numbered).drop("_clean", "_number")


def micros(c: Column | str) -> Column:
    """A time in a session as microseconds: ``76.055``, ``73,641``, ``46.560s``, ``20622ms``, ``0:37.549``, ``00:02:15.572``; else null."""
    t = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"[{WS}]+", "")), ",", ".")
    n = lambda x: F.try_cast(x, "double") if hasattr(F, "try_cast") else x.try_cast("double")
    part = lambda i: n(F.regexp_extract(t, r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$", i))
    seconds = (
        F.when(t.rlike(r"^-?\d+(\.\d+)?ms$"), n(F.regexp_replace(t, "ms$", "")) / 1000)
        .when(t.rlike(r"^-?\d+(\.\d+)?s?$"), n(F.regexp_replace(t, "s$", "")))
        .when(t.rlike(r"^(\d+:)?\d+:\d+(\.\d+)?$"), F.coalesce(part(1), F.lit(0.0)) * 3600 + part(2) * 60 + part(3))
    )
    return F.round(seconds * 1_000_000).cast("long")
