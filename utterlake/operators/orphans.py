"""References to records that don't exist, kept as signed counts per key.

The state holds, per key and kind, how many references (``ref``), existing rows (``live``) and deleted rows (``gone``) there are at
each load time, as signed counts. So every part of it can be withdrawn: a deletion is -1 live and +1 gone, and the earliest load or
reference is found among what is left, not kept as a minimum that nothing could take back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions.speakers import is_known, with_speaker
from utterlake.operators.counts import SignedCounts, halfway, loaded_between, row_changes
from utterlake.operators.tokens import year_of
from utterlake.session import new_path

KEY = ["ref_field", "key"]
#: The state: one row per key, kind and load time.
STATE_SCHEMA, STATE_KEYS = "ref_field string, key string, kind string, at timestamp, n bigint", ["ref_field", "key", "kind", "at"]


def _sign(df: DataFrame):
    return (F.col("sign") if "sign" in df.columns else F.lit(1)).cast("bigint").alias("n")


def reference_deltas(refs: DataFrame) -> DataFrame:
    """(ref_field, key, at[, sign]) to deltas: +1 reference each, -1 where sign is -1 (a reference withdrawn)."""
    return refs.where("key is not null").select(*KEY, F.lit("ref").alias("kind"), F.col("at").cast("timestamp").alias("at"), _sign(refs))


def existence_deltas(rows: DataFrame) -> DataFrame:
    """(ref_field, key, loaded_at, deleted_at[, sign]) to deltas: a row counts as live or, with deleted_at, as gone; -1 where sign is -1.
    A row that is deleted after it was taken is two signed rows, as it was and as it is (`counts.row_changes`)."""
    kind = F.when(F.col("deleted_at").isNull(), "live").otherwise("gone").alias("kind")
    return rows.where("key is not null").select(*KEY, kind, F.col("loaded_at").cast("timestamp").alias("at"), _sign(rows))


def fold(deltas: DataFrame) -> DataFrame:
    """Sum signed deltas per key, kind and time; a hot key is pre-aggregated in every map task."""
    return deltas.groupBy(*STATE_KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def advance(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state after more deltas; what fell back to nothing leaves it."""
    return fold(state.select(*STATE_KEYS, "n").unionByName(deltas.select(*STATE_KEYS, "n")))


def summed_up(state: DataFrame) -> DataFrame:
    """(ref_field, key, refs, existing, gone, first_live, first_ref) from the state."""

    def n(kind: str):
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))

    def first(kind: str):
        return F.min(F.when((F.col("kind") == kind) & (F.col("n") > 0), F.col("at")))

    return state.groupBy(*KEY).agg(n("ref").alias("refs"), n("live").alias("existing"), n("gone").alias("gone"), first("live").alias("first_live"), first("ref").alias("first_ref"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with references and no existing row, or one that was first loaded after the first reference."""
    s = summed_up(state).where((F.col("refs") > 0) & ((F.col("existing") <= 0) | (F.col("first_live") > F.col("first_ref"))))
    return s.withColumn("state", F.when(F.col("existing") > 0, "late").when(F.col("gone") > 0, "deleted").otherwise("missing"))


def spoken_references(search_master: DataFrame, file_meta: DataFrame) -> DataFrame:
    """(key, utt_id, year, at) of utterances whose label names a speaker, resolved along the session list as it stands now; the key is
    ``year|id``. An utterance without utt_id or year refers to nothing, a label that names no speaker neither."""
    u = search_master.select("utt_id", "year", "session_id", "speaker_id", F.col("loaded_at").alias("at")).where("utt_id is not null")
    spoken = with_speaker(u, file_meta).where(is_known(F.col("speaker")) & F.col("year").isNotNull())
    return spoken.select(F.concat_ws("|", "year", "speaker").alias("key"), "utt_id", "year", "at")


def corpus_deltas(search_master: DataFrame, bareun_raw: DataFrame, file_meta: DataFrame, speakers: DataFrame, after: object | None = None, until: object | None = None) -> DataFrame:
    """The deltas of the three reference fields for what was loaded or deleted after one time and until another (null: from nothing, to
    the end)."""
    sm = loaded_between(search_master, after, until)
    spoken = spoken_references(sm, file_meta).select(F.lit("speaker_id").alias("ref_field"), "key", "at")
    u = sm.where("utt_id is not null").select("utt_id", "session_id", F.col("loaded_at").alias("at"))
    refs = spoken.unionByName(u.select(F.lit("utt_id").alias("ref_field"), F.col("utt_id").alias("key"), "at"))
    refs = refs.unionByName(u.select(F.lit("file_id").alias("ref_field"), F.col("session_id").alias("key"), "at"))

    def rows(df: DataFrame, field: str, key) -> DataFrame:
        return existence_deltas(row_changes(df.select(F.lit(field).alias("ref_field"), key.alias("key"), "loaded_at", "deleted_at"), after, until))

    out = reference_deltas(refs).unionByName(rows(bareun_raw, "utt_id", F.col("utt_id"))).unionByName(rows(file_meta, "file_id", F.col("file_id")))
    return out.unionByName(rows(speakers.where("year is not null and id is not null"), "speaker_id", F.concat_ws("|", "year", "id")))


def orphan_state(search_master: DataFrame, bareun_raw: DataFrame, file_meta: DataFrame, speakers: DataFrame, path: str, until: list | None = None) -> DataFrame:
    """The state after loading the corpus in steps, one delta per time in ``until`` (the last, null, takes the rest), through a store at
    ``path``. A store that exists goes on from where it stands: a step of the same name isn't taken twice."""
    store = SignedCounts(search_master.sparkSession, path, STATE_SCHEMA, STATE_KEYS)
    after = None
    for step in until if until is not None else [None]:
        store.apply(corpus_deltas(search_master, bareun_raw, file_meta, speakers, after, step), f"{after}..{step}")
        after = step
    return store.read()


def orphan_report(search_master: DataFrame, bareun_raw: DataFrame, file_meta: DataFrame, speakers: DataFrame, path: str | None = None, until: list | None = None) -> DataFrame:
    """One row per utterance (speaker_id, utt_id) or session (file_id) whose reference has no record: ref_field, row_key, year, state.

    state is ``missing`` (no such key), ``deleted`` (all its rows are) or ``late`` (its first existing row was loaded after the
    referring row). Copies of an utterance count once, by their earliest load. Null keys and null labels refer to nothing. The state
    is built from change deltas, by default in two, before and after the middle of the load times: the second brings rows that come
    later and takes back those deleted since. Only the keys at fault go back to the utterances, as a join on the key.
    """
    spark = search_master.sparkSession
    state = orphan_state(search_master, bareun_raw, file_meta, speakers, path or new_path(spark, "orphans"), until if until is not None else [*filter(None, [halfway(search_master)]), None])
    bad = orphan_keys(state)
    own = bad.where("ref_field <> 'speaker_id'").select("ref_field", F.col("key").alias("row_key"), year_of("key").alias("year"), "state")
    utterances = spoken_references(search_master, file_meta).join(bad.where("ref_field = 'speaker_id'").select("key", "state", "first_live"), "key")
    by_utt = utterances.groupBy("utt_id", "year", "state", "first_live").agg(F.min(F.col("at").cast("timestamp")).alias("at"))
    late = (F.col("state") != "late") | (F.col("first_live") > F.col("at"))
    return own.unionByName(by_utt.where(late).select(F.lit("speaker_id").alias("ref_field"), F.col("utt_id").alias("row_key"), "year", "state"))


def orphan_counts(report: DataFrame) -> DataFrame:
    """Orphans per table and year."""
    return report.groupBy("ref_field", "year", "state").agg(F.count("*").alias("n"))
