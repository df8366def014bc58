"""Queries over the tiers of textgrids: enrichment, stitched sessions, containment, rates; and over streams and audio headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.catalog import Catalog
from utterlake.functions.text import packed_roman, packed_tagged
from utterlake.operators import intervals, sense, tokens
from utterlake.operators.compact import data_files
from utterlake.operators.packed import one_per_key
from utterlake.plans.frequency import _stored_gold, _wsd, utterances
from utterlake.plans.layers import BLOCK
from utterlake.session import new_path, stored
from utterlake.sources import audio, textgrid
from utterlake.streaming.refresh import refresh

#: Order of the tiers of an enriched textgrid.
TIER_ORDER = ["words", "phones", "morphemes", "utterance"]


def _grids(spark: SparkSession, root: str) -> DataFrame:
    """(utt_id, tier, idx, xmin, xmax, text): the newest textgrid of each utterance as interval rows, ties to the greater path."""
    f = data_files(Catalog(spark, root).tiny_files).where("layer = 'textgrid_eojeol' and content is not null")
    stem = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.[^.]*$", 1)
    f = f.select(F.regexp_replace(stem, r" ?\([0-9]+\)$", "").alias("utt_id"), "path", "modified_at", "content").where("utt_id <> ''")
    at = F.struct(F.coalesce(F.col("modified_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col("path"))
    newest = f.groupBy("utt_id").agg(F.max_by("content", at).alias("content"))
    return textgrid.intervals(newest.select(F.col("utt_id").alias("path"), "content")).withColumnRenamed("path", "utt_id")


def _durations(grids: DataFrame) -> DataFrame:
    return grids.groupBy("utt_id").agg(F.max("xmax").alias("dur"))


def enriched_tiers(spark, root):
    """Four tiers of every utterance with a textgrid: its words, the predicted sounds and the morphs mirrored on them, and the utterance.

    A tier whose tokens don't fit the words is one interval behind a mark; an utterance without an analysis or prediction lacks the tier.
    """
    t = Catalog(spark, root)
    grids = stored(_grids(spark, root), "grids")  # read for the words, their number, the lengths and each mirrored tier
    words, dur = grids.where("tier = 'words'").drop("tier"), _durations(grids)
    sounds = packed_roman(one_per_key(t.search_master, "utt_id", "pron_pred_roman"), "pron_pred_roman")
    sounds = sounds.select("utt_id", F.array_join(F.transform("words", lambda w: F.array_join(w, " _ ")), " | ").alias("value")).where("value <> ''")
    u = utterances(spark, root)
    morphs = packed_tagged(u, "tagged").select("utt_id", F.array_join(F.transform("words", lambda w: F.array_join(w, "+")), " ").alias("value")).where("value <> ''")
    mirrored = lambda v, tier, by: intervals.mirror_tokens(words, v.join(dur, "utt_id"), "utt_id", "value", by).withColumn("tier", F.lit(tier))
    own = words.select("utt_id", "xmin", "xmax", F.when(textgrid.is_silence(F.col("text")), "").otherwise(F.col("text")).alias("text"), F.lit(False).alias("warned"), F.lit("words").alias("tier"))
    whole = dur.join(u.select("utt_id", "form"), "utt_id", "left").select("utt_id", F.lit(0.0).alias("xmin"), F.col("dur").alias("xmax"), F.coalesce("form", F.lit("")).alias("text"), F.lit(False).alias("warned"), F.lit("utterance").alias("tier"))
    out = own.unionByName(mirrored(sounds, "phones", "|")).unionByName(mirrored(morphs, "morphemes", None)).unionByName(whole)
    return out.select("utt_id", "tier", "xmin", "xmax", "text", "warned")


def tier_gaps(spark, root):
    """One row: utterances with a textgrid, and how many of them lack words, an analysis or a prediction."""
    e = enriched_tiers(spark, root).groupBy("utt_id").agg(F.collect_set("tier").alias("tiers"))
    lacks = lambda tier: F.count_if(~F.array_contains("tiers", tier)).alias(f"no_{tier}")
    return e.agg(F.count("*").alias("n"), lacks("words"), lacks("phones"), lacks("morphemes"))


def tier_files(spark, root):
    """The enriched tiers written as long textgrids, in their order."""
    e = enriched_tiers(spark, root)
    numbered = intervals.prefix_scan(e, ["utt_id", "tier"], ["xmin", "xmax", "text"], position="idx")
    return textgrid.rendered(numbered, "utt_id", TIER_ORDER)


def stitched_tiers(spark, root):
    """The words of a session's textgrids laid end to end in one tier without gaps or overlaps; utterances without one are skipped."""
    grids = _grids(spark, root)
    dur = _durations(grids).select("utt_id", "dur", tokens.session_of("utt_id").alias("session_id"), F.element_at(F.split("utt_id", r"\."), -1).try_cast("int").alias("num"))
    at = intervals.running_offset(dur, ["session_id"], ["num", "utt_id"], "dur", F.floor(F.col("num") / BLOCK))
    words = intervals.shifted(grids.where("tier = 'words'").select("utt_id", "xmin", "xmax", "text"), at, "utt_id").withColumn("session_id", tokens.session_of("utt_id"))
    total = at.groupBy("session_id").agg(F.max("until").alias("total"))
    tiled = intervals.tile(words.join(total, "session_id"), ["session_id"], ["xmin", "xmax", "text"], total="total", block=F.floor(F.col("xmin") / 600))
    return tiled.select("session_id", F.round("xmin", 6).alias("xmin"), F.round("xmax", 6).alias("xmax"), "text")


def contained_words(spark, root):
    """Each word with the interval of the utterance tier that holds its middle."""
    g = _grids(spark, root)
    kids = g.where("tier = 'words'").select("utt_id", "idx", "xmin", "xmax", "text")
    return intervals.contained(kids, g.where("tier = 'utterance'").select("utt_id", "idx", "xmin", "xmax"), "utt_id")


def speech_rates(spark, root):
    """Duration, silence, words with content and their rate per textgrid."""
    r = intervals.speech_rate(_grids(spark, root), ["utt_id"], "words", "words").withColumnRenamed("phones", "n_words")
    return r.select("utt_id", F.round("dur", 6).alias("dur"), F.round("pause", 6).alias("pause"), "n_words", F.round("rate", 6).alias("rate"))


def spn_ratio(spark, root):
    """The share of words that weren't pronounced, per textgrid."""
    return textgrid.unpronounced(_grids(spark, root).withColumnRenamed("utt_id", "path"), "words").withColumnRenamed("path", "utt_id")


def pron_index(spark, root):
    """The pronunciation of each word of a lexicon, here the gold's senses with their form; verbs also answer for their stem."""
    w = _wsd(_stored_gold(spark, root)).where("pos is not null")
    word = F.when(F.col("pos").isin("VV", "VA"), F.concat("form", F.lit("다"))).otherwise(F.col("form"))
    return sense.pronunciation_index(w.select(word.alias("word"), F.col("pos").alias("pos_tag"), F.col("sense_id").alias("sense_no"), word.alias("pron_1")))


def stream_minutes(spark, root):
    """Events by minute and kind, taken in as a stream of files: each batch adds its counts to a sink that is summed up."""
    sink, done = new_path(spark, "minutes"), new_path(spark, "minutes-checkpoint")
    minute = F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute")
    counts = lambda b: b.groupBy(minute, "event_type").agg(F.count("*").alias("n"))
    refresh(spark, root, Catalog(spark, root).events.schema, counts, sink, done, glob="events.parquet")
    return spark.read.schema("minute string, event_type string, n bigint").parquet(sink).groupBy("minute", "event_type").agg(F.sum("n").alias("n"))


def wav_headers(spark, root):
    """Headers for audio of the lengths of the small files, and the seconds read back from them."""
    f = Catalog(spark, root).tiny_files.select("path", (F.col("size_bytes") * 2).alias("data_bytes")).distinct()
    head = f.withColumn("header", audio.wav_header(F.col("data_bytes")))
    return head.select("path", "data_bytes", F.hex("header").alias("header"), F.round(audio.header_seconds(F.col("header")), 6).alias("seconds"))


QUERIES = {f.__name__: f for f in (enriched_tiers, tier_gaps, tier_files, stitched_tiers, contained_words, speech_rates, spn_ratio, pron_index, stream_minutes, wav_headers)}
