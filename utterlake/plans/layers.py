"""Reference queries: search master, dimensions, coverage, intervals, search, pronunciation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterlake.catalog import Catalog
from utterlake.functions.hangul import CODAS, ONSETS, boundary_table, compose_codes, romanized, to_ipa, ipa_map, with_pronunciation
from utterlake.functions.speakers import micros
from utterlake.functions.hangul import syllable_codes
from utterlake.functions.speakers import with_speaker
from utterlake.functions.text import INVISIBLE, nfc, packed_tagged, rpartition_slash, split_ws
from utterlake.operators import coverage, dims, freq, intervals, search, tokens
from utterlake.plans.frequency import live, morph_positions, utterances
from utterlake.sources import textgrid

META = {c: dims.UNKNOWN for c in ("category_norm", "discourse_mode", "topic", "relation", "date", "in_ml2025_gold")}
SPEAKER = {c: dims.UNKNOWN for c in ("sex_norm", "age_norm", "occupation_norm", "education_ord", "birthplace_norm", "current_residence_norm")}
EXTRA = {"original_form": dims.UNKNOWN, "start": "", "end_sec": "", "note": dims.UNKNOWN}
#: Utterance numbers and microseconds of a session in one block of the session's order.
BLOCK, BLOCK_US = 512, 600_000_000


def _t(spark: SparkSession, root: str) -> Catalog:
    return Catalog(spark, root)


def _normalized_form(df: DataFrame) -> DataFrame:
    return df.withColumn("form", nfc(F.regexp_replace(F.coalesce("form", F.lit("")), f"[{INVISIBLE}]+", "")))


def master(spark, root) -> DataFrame:
    """One row per utterance with the metadata of its file and speaker, the extras of its transcript and its coverage; a miss gives
    ``미상`` (times '', flags 0), a blank stays blank.

    What is keyed by utterance meets in one aggregation. The speaker is met by the id that the label stands for. Dimensions are cut to
    the last live row of a key first, so nothing fans out; the joins are plain equi-joins whose strategy the engine picks by size.
    """
    t = _t(spark, root)
    own = t.bareun_raw.select("utt_id", "form", "tagged", "speaker_id", "n_morphs", "loaded_at")
    u = dims.gathered(
        "utt_id",
        own=(own, ["loaded_at", "form", "tagged", "speaker_id", "n_morphs"]),
        extra=(t.dialogue_json.select("utt_id", *EXTRA, "loaded_at"), ["loaded_at", *EXTRA]),
        noted=(t.search_master.select("utt_id", "has_wav", "quarantined", "loaded_at"), ["loaded_at", "has_wav", "quarantined"]),
        grid=(_inventory(spark, root).where("ext = 'textgrid'").select("utt_id", F.lit("1").alias("has_tg_eojeol")), ["has_tg_eojeol"]),
    ).where("own is not null")
    fill = lambda source, c, d: F.when(F.col(source).isNull(), d).otherwise(F.coalesce(F.col(f"{source}.{c}"), F.lit(""))).alias(c)
    u = u.select(
        "utt_id", "own.form", "own.tagged", "own.speaker_id", "own.n_morphs", tokens.session_of("utt_id").alias("session_id"), tokens.sequence_of("utt_id").alias("utt_seq"), tokens.year_of("utt_id").alias("year"),
        *[fill("extra", c, d) for c, d in EXTRA.items()], fill("noted", "has_wav", "0"), fill("noted", "quarantined", ""),
        F.when(F.col("noted").isNotNull() & F.col("grid").isNotNull(), "1").otherwise("0").alias("has_tg_eojeol"),
    )
    u = with_speaker(u, t.file_meta, to="_who")
    meta = dims.last_wins(live(t.file_meta).select(F.col("file_id").alias("session_id"), *META, "loaded_at", "doc_id"), ["session_id"], ["loaded_at", "doc_id", *META])
    spk = dims.last_wins(live(t.speakers_normalized).select("year", F.col("id").alias("_who"), *SPEAKER, "loaded_at"), ["year", "_who"], ["loaded_at", *SPEAKER])
    m = dims.join_with_defaults(u, meta, ["session_id"], META, blank_is_missing=False)
    m = dims.join_with_defaults(m, spk, ["year", "_who"], SPEAKER, blank_is_missing=False).drop("_who")
    return m.withColumn("dur", F.round((micros("end_sec") - micros("start")) / 1e6, 3)).withColumn("n_eojeol", F.size(split_ws("form")).cast("bigint"))


def master_checks(spark, root):
    """The invariants of a build in one row: rows, misses of each join, warnings of the alignment, words that don't match their analysis."""
    u = utterances(spark, root)
    m = packed_tagged(master(spark, root), "tagged", "_words")
    n = m.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("category_norm") == dims.UNKNOWN).alias("no_meta"), F.count_if(F.col("sex_norm") == dims.UNKNOWN).alias("no_speaker"),
        F.count_if(F.col("original_form") == dims.UNKNOWN).alias("no_transcript"), F.count_if(F.col("dur").isNull()).alias("no_duration"),
        F.count_if((F.size("_words") > 0) & (F.col("n_eojeol") != F.size("_words"))).alias("word_mismatches"),
    )
    return n.join(F.broadcast(u.agg(F.count("*").alias("n_utterances"))))  # one row each


def flagship(spark, root, tagged_roman: bool = False):
    """The search master with predicted pronunciation and, if asked, the romanized analysis."""
    m = with_pronunciation(_normalized_form(master(spark, root)).drop("n_eojeol"))
    if not tagged_roman:
        return m
    words = lambda w: F.array_join(F.transform(w, _unit_roman), " + ")
    return packed_tagged(m, "tagged", "_words").withColumn("tagged_roman", F.array_join(F.transform("_words", words), " | ")).drop("_words")


def pronunciation(spark, root):
    return with_pronunciation(_normalized_form(utterances(spark, root).select("utt_id", "form", "tagged"))).drop("form", "tagged")


def spelled_roman(spark, root):
    """Romanized spelling of every utterance of the search master."""
    u = _normalized_form(_t(spark, root).search_master.where("utt_id is not null").groupBy("utt_id").agg(F.max("form").alias("form")))
    return with_pronunciation(u, tagged=None).select("utt_id", "form_roman")


def _unit_roman(unit):
    """One morph: ``roman/TAG``; a surface that isn't Hangul throughout stays, a unit without a slash stays whole."""
    morph, tag = rpartition_slash(unit)
    shown = F.when(morph.rlike("^[가-힣]+$"), romanized(syllable_codes(morph), spelled=True)).when(morph != "", morph).otherwise(unit)
    return F.when(tag != "", F.concat(shown, F.lit("/"), tag)).otherwise(shown)


def tagged_roman(spark, root):
    """Romanized morphs with their tags in four levels: sounds, syllables, morphs, eojeols."""
    u = packed_tagged(utterances(spark, root).select("utt_id", "tagged"), "tagged", "_words").where(F.size("_words") > 0)
    return u.select("utt_id", F.array_join(F.transform("_words", lambda w: F.array_join(F.transform(w, _unit_roman), " + ")), " | ").alias("tagged_roman"))


def g2p_boundary(spark, root):
    """The whole boundary table: coda, onset, i after it, end of a verb stem; what is spoken."""
    table = F.expr(f"array({', '.join(map(str, boundary_table()[0]))})")
    codas, onsets = F.lit([c.strip() for c in CODAS]), F.lit(list(ONSETS))
    i = F.col("id").cast("int")
    r = F.get(table, i)
    div = lambda a, n: F.floor(a / n).cast("int")
    return spark.range(len(boundary_table()[0])).select(
        F.get(codas, div(i, 76)).alias("coda"), F.get(onsets, div(i, 4) % 19).alias("onset"), (div(i, 2) % 2 == 1).alias("before_i"), (i % 2 == 1).alias("stem_end"), F.get(codas, div(r, 19)).alias("spoken_coda"), F.get(onsets, r % 19).alias("spoken_onset")
    )


def _codes(spark, root):
    return _t(spark, root).lineitem.select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 37 + F.col("l_linenumber")) % 11172).cast("int").alias("code"))


def hangul_letters(spark, root):
    c = F.col("code")
    div = lambda a, n: F.floor(a / n).cast("int")
    return _codes(spark, root).select("l_orderkey", "l_linenumber", div(c, 588).alias("onset"), div(c % 588, 28).alias("vowel"), (c % 28).alias("coda"), compose_codes(F.array(c)).alias("syllable"))


def syllable_roman(spark, root):
    d = _codes(spark, root).select("code").distinct()
    d = d.select("code", romanized(F.array("code"), spelled=True).alias("roman"))
    return d.select("code", "roman", to_ipa(F.col("roman"), ipa_map()).alias("ipa"))


def categories(spark, root):
    c = _t(spark, root).file_meta.select("category").distinct()
    return c.select("category", dims.category("category").alias("category_norm"), dims.register("category").alias("register"), dims.discourse_mode("category").alias("discourse_mode"))


def speakers_norm(spark, root):
    s = _t(spark, root).speakers_normalized
    return s.select("year", "id", dims.or_unknown("sex").alias("sex_norm"), dims.age_group("age").alias("age_norm"), dims.occupation("occupation").alias("occupation_norm"), dims.or_unknown("education").alias("education_norm"), dims.education_rank("education").alias("education_ord"), dims.or_unknown("birthplace").alias("birthplace_norm")).distinct()


def speakers_changed(spark, root):
    s = _t(spark, root).speakers_normalized
    changed = lambda raw, norm: F.count_if(~F.trim(F.coalesce(raw, F.lit(""))).eqNullSafe(norm))
    return s.agg(changed("sex", dims.or_unknown("sex")).alias("sex"), changed("age", dims.age_group("age")).alias("age"), changed("occupation", dims.occupation("occupation")).alias("occupation"))


def first_speakers(spark, root):
    """The first row of each speaker id by load time and year."""
    s = _t(spark, root).speakers_normalized.select("id", "year", "sex_norm", "age_norm", "loaded_at")
    return dims.first_wins(s, ["id"], ["loaded_at", "year"]).select("id", "year", "sex_norm", "age_norm")


def id_keys(spark, root):
    u = _t(spark, root).dialogue_json.select("utt_id").where("utt_id is not null").distinct()
    return u.select("utt_id", tokens.session_of("utt_id").alias("session_id"), tokens.sequence_of("utt_id").alias("utt_seq"), tokens.year_of("utt_id").alias("year"), search.layer_path("utt_id", "06_textgrid_eojeol", "TextGrid").alias("path"))


def labs(spark, root):
    u = packed_tagged(utterances(spark, root), "tagged", "_words")
    return u.select("utt_id", tokens.form_to_lab("form").alias("lab"), tokens.form_to_clean_lab("form").alias("clean_lab"), F.coalesce(tokens.packed_lab(F.col("_words")), F.lit("")).alias("tagged_lab"))


def _inventory(spark, root):
    f = _t(spark, root).tiny_files.select("path")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), r" \([0-9]+\)$", "")
    return f.select("path", stem.alias("utt_id"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext")).where(~name.rlike("^[_.]"))


def coverage_flags(spark, root):
    """Utterances with their textgrid and their lab file."""
    u = _t(spark, root).search_master.select("utt_id", "year").where("utt_id is not null").distinct()
    inv = _inventory(spark, root)
    return coverage.with_presence(u, "utt_id", has_textgrid=inv.where("ext = 'textgrid'"), has_lab=inv.where("ext = 'lab'"))


def coverage_summary(spark, root):
    s = coverage.coverage_summary(coverage_flags(spark, root), "has_textgrid", "has_lab", ["year"])
    return s.withColumn("year", F.coalesce("year", F.lit("total")))


def still_missing(spark, root):
    """Utterances whose audio is marked present, whose textgrid is marked absent, and for which no file is listed."""
    failed = _t(spark, root).search_master.where("has_wav = '1' and has_tg_eojeol = '0'").select("utt_id", "year").distinct()
    return coverage.still_missing(failed, _inventory(spark, root).where("ext = 'textgrid'").select("utt_id").distinct(), "utt_id")


def recovery(spark, root):
    u = _t(spark, root).search_master.where("utt_id is not null").groupBy("utt_id", "year").agg(F.max((F.coalesce("has_wav", F.lit("")) == "1") & (F.coalesce("has_tg_eojeol", F.lit("")) == "0")).alias("failed"))
    u = coverage.with_presence(u, "utt_id", back=_inventory(spark, root).where("ext = 'textgrid'"))
    r = coverage.recovery(u, F.col("failed"), F.col("back"), "year")
    return r.withColumn("year", F.coalesce("year", F.lit("total")))


def length_classes(spark, root):
    u = _t(spark, root).search_master.where("utt_id is not null").groupBy("utt_id", "year").agg(F.max(F.col("dur").try_cast("double")).alias("dur"))
    return freq.pivot_frequency(u.withColumn("class", coverage.length_class(F.col("dur"))), ["year"], "class", ["absent", "short", "normal"], "n_")


def empty_analysis(spark, root):
    """Whether a session has an utterance with a form and no analysis, how many, and how many without a form."""
    u = utterances(spark, root).withColumn("session_id", tokens.session_of("utt_id"))
    blank = F.trim(F.coalesce("form", F.lit(""))) == ""
    bad = ~blank & (F.trim(F.coalesce("tagged", F.lit(""))) == "")
    return u.groupBy("session_id").agg(F.bool_or(bad).alias("any_empty"), F.count_if(bad).alias("n_empty"), F.count_if(blank).alias("n_blank"))


def _spoken(spark, root):
    """One row per utterance of the search master, its times in microseconds, null where they can't be read."""
    s = _t(spark, root).search_master.where("utt_id is not null").groupBy("session_id", "utt_id").agg(F.max("form").alias("form"), F.max("start").alias("start"), F.max("end_sec").alias("end_sec"))
    return s.select("session_id", "utt_id", "form", F.element_at(F.split("utt_id", r"\."), -1).cast("int").alias("num"), micros("start").alias("b"), micros("end_sec").alias("e"))


def _timed(spark, root):
    return _spoken(spark, root).where("b is not null and e is not null and e >= b")


def _by_number(c: str = "num"):
    return F.floor(F.col(c) / BLOCK)


def session_order(spark, root):
    """Rank of each utterance as spoken and as its id is spelled."""
    u = _t(spark, root).search_master.select("session_id", "utt_id").where("utt_id is not null").distinct()
    number = F.element_at(F.split("utt_id", r"\."), -1).try_cast("int")
    u = u.withColumn("_order", tokens.numeric_order("utt_id")).withColumn("_parts", F.transform(F.slice("_order", 1, F.size("_order") - 1), lambda x: x))
    # blocks of the spoken order: the parts before the number, and the number's block; of the spelled order: the beginning of the id
    spoken = intervals.prefix_scan(u, ["session_id"], ["_order", "utt_id"], F.struct("_parts", F.floor(number / BLOCK).alias("n")), position="spoken")
    both = intervals.prefix_scan(spoken, ["session_id"], ["utt_id"], F.substring("utt_id", 1, 21), position="spelled")
    return both.select("utt_id", "spoken", "spelled")


def keyword_context(spark, root):
    """Two utterances before and after each that speaks of travel."""
    u = _spoken(spark, root).select("session_id", "utt_id", "num", "form")
    return search.context(u, F.coalesce(F.col("form"), F.lit("")).contains("여행"), "session_id", ["num", "utt_id"], 2, _by_number())


def session_offsets(spark, root):
    """The utterances of a session that have times laid end to end, in microseconds."""
    t = _timed(spark, root).withColumn("length", F.col("e") - F.col("b"))
    return intervals.running_offset(t, ["session_id"], ["num", "utt_id"], "length", _by_number()).select("session_id", "utt_id", "offset", "until")


def _tier(spark, root):
    t = _timed(spark, root)
    return t.select("session_id", "utt_id", (F.col("b") / 1e6).alias("xmin"), (F.col("e") / 1e6).alias("xmax"), F.col("utt_id").alias("text"), F.floor(F.col("b") / BLOCK_US).alias("_at"))


def session_tiles(spark, root):
    """The utterances of a session that have times as one tier without gaps."""
    return intervals.tile(_tier(spark, root), ["session_id"], ["xmin", "xmax", "utt_id"], block=F.col("_at"))


def _durations(spark, root):
    """How long each session lasts: until its greatest readable end."""
    return _spoken(spark, root).where("e is not null").groupBy(F.col("session_id").alias("of")).agg((F.max("e") / 1e6).alias("dur"))


def tiers_normalized(spark, root):
    """The tier of each whole session, which lasts until its greatest readable end."""
    t = _tier(spark, root).join(_durations(spark, root), F.col("session_id").eqNullSafe(F.col("of"))).drop("of")
    return intervals.normalize_tier(t, ["session_id"], ["xmin", "xmax", "utt_id"], "dur", F.col("_at"))


def _words(spark, root):
    e = _t(spark, root).events.select("user_id", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))
    return e.select("user_id", "event_id", "value", (F.col("us") / 1e6).alias("xmin"), (F.col("us") / 1e6 + 60.0).alias("xmax"))


_DAY = lambda: F.floor(F.col("xmin") / 86_400)


def _paused(spark, root):
    return intervals.with_pause(_words(spark, root), ["user_id"], block=_DAY())


def pauses(spark, root):
    return _paused(spark, root).select("user_id", "event_id", F.round("gap", 3).alias("gap"), "boundary")


def phrases(spark, root):
    p = intervals.phrases(_paused(spark, root), ["user_id"], block=_DAY())
    return p.select("user_id", F.col("ap").cast("bigint"), F.col("ip").cast("bigint"), F.round("xmin", 3).alias("xmin"), F.round("xmax", 3).alias("xmax"), "n_words")


def pitch_resets(spark, root):
    """Boundaries where the pitch of the next event is two semitones above, among events that follow at once."""
    e = _t(spark, root).events.select("user_id", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("xmin"))
    e = intervals.prefix_scan(e, ["user_id"], ["xmin", "event_id"], _DAY(), nexts={"xmax": F.col("xmin")}).withColumn("xmax", F.coalesce("xmax", "xmin"))
    p = intervals.with_pause(e, ["user_id"], pitch=("value", "value"), block=_DAY())
    return p.select("user_id", "event_id", F.round("gap", 3).alias("gap"), "boundary")


def _tones(spark, root):
    """Samples of the last day of a user's events stand for the last stretch of pitch: the tone from its first to its last."""
    e = _t(spark, root).events.select("user_id", "ts", "event_id", "value")
    last = e.groupBy("user_id").agg(F.max("ts").alias("until"))
    k = F.struct("ts", "event_id")
    near = e.join(last, "user_id").where(F.col("ts") >= F.col("until") - F.expr("interval 1 day"))
    return near.groupBy("user_id").agg(F.min_by("value", k).alias("first_hz"), F.max_by("value", k).alias("last_hz"))


def boundary_tones(spark, root):
    return _tones(spark, root).select("user_id", intervals.boundary_tone(F.col("first_hz"), F.col("last_hz")).alias("tone"))


def prosody_segments(spark, root):
    """The phrases of a user's events as labelled segments."""
    tone = F.when(F.col("value") >= 66, "H%").when(F.col("value") <= 33, "L%").otherwise("F%")
    p = intervals.labelled_phrases(_paused(spark, root).withColumn("tone", tone), ["user_id"], "tone", block=_DAY())
    return p.select("user_id", F.col("ap").cast("bigint").alias("ap"), F.round("xmin", 3).alias("xmin"), F.round("xmax", 3).alias("xmax"), "label")


def pitch_stats(spark, root):
    e = _t(spark, root).events.select("user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    p = intervals.pitch_summary(e, ["user_id"], "t", "value")
    return p.select("user_id", F.round("mean", 6).alias("mean"), "lowest", "highest", "n", F.round(F.col("slope") * 1e6, 6).alias("slope"))


def minute_averages(spark, root):
    """Samples averaged per minute."""
    e = _t(spark, root).events.withColumn("minute", F.substring(F.col("ts").cast("string"), 1, 16))
    return e.groupBy("minute").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def textgrid_intervals(spark, root):
    """Interval rows of all textgrids among the small files."""
    f = _t(spark, root).tiny_files.where(F.lower("path").endswith(".textgrid"))
    return textgrid.intervals(f)


def textgrid_labels(spark, root):
    r = textgrid_intervals(spark, root)
    return r.groupBy("path").agg(F.count("*").alias("n"), F.count_if(~textgrid.is_silence(F.col("text"))).alias("n_sound"))


def regex_search(spark, root):
    """Monologues or dialogues of one year whose predicted pronunciation has a tense onset after a coda k."""
    m = search.regex_search(_t(spark, root).search_master, "pron_pred_roman", "k [_.-] (KK|TT|PP|SS|JJ)", year="2021", discourse_mode="대화")
    return m.select("utt_id", "form", "pron_pred_roman").distinct()


def hitlist(spark, root):
    """Rows of a hit list: first utterances, and the whole sessions of 2020."""
    s = _t(spark, root).search_master.select("utt_id", "session_id", "year", "utt_seq").distinct()
    hits = s.where("year = '2020'").select(F.lit("").alias("utt_id"), "session_id").unionByName(s.where("utt_seq = '1'").select("utt_id", "session_id"))
    return search.by_hitlist(s, hits).select("utt_id", "session_id")


def located(spark, root):
    """The best file of each utterance: a textgrid, else a backup of one, else a lab."""
    u = _t(spark, root).search_master.select("utt_id").where("utt_id is not null").distinct()
    inv = _inventory(spark, root).withColumn("utt_id", F.regexp_replace("utt_id", r"(?i)\.textgrid$", ""))
    files = inv.where(F.col("ext").isin("textgrid", "bak", "lab")).select("utt_id", F.col("ext").alias("layer"), F.when(F.col("ext") == "textgrid", 1).when(F.col("ext") == "bak", 2).otherwise(3).alias("priority"), "path")
    return search.locate(u, files)


def n_insertion(spark, root):
    return search.n_insertion_candidates(morph_positions(spark, root))


def words_by_set(spark, root):
    """How the words of two years overlap: union, intersection and difference."""
    u = utterances(spark, root).select(tokens.year_of("utt_id").alias("year"), F.explode(split_ws("form")).alias("token"))
    a, b = (u.where(F.col("year") == y).select("token").distinct() for y in ("2020", "2021"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.subtract(b), "except"))


def top_sessions(spark, root):
    """The ten sessions with the most missing textgrids, as a report."""
    f = still_missing(spark, root).groupBy(tokens.session_of("utt_id").alias("session_id")).agg(F.count("*").alias("n"))
    return f.orderBy(F.desc("n"), "session_id").limit(10)


def first_sessions(spark, root):
    """All utterances of the first three sessions by name: a pilot."""
    u = _t(spark, root).search_master.select("session_id", "utt_id").distinct()
    return u.join(F.broadcast(u.select("session_id").distinct().orderBy("session_id").limit(3)), "session_id", "left_semi")


def seeded_sample(spark, root):
    """A reproducible sample of a hundred utterances."""
    u = utterances(spark, root).select("utt_id")
    return u.orderBy(F.md5(F.concat(F.lit("42:"), "utt_id")), "utt_id").limit(100)


def event_props(spark, root):
    return _t(spark, root).events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def pron_compare(spark, root):
    """Words whose predicted pronunciation is their spelling, per utterance: two columns compared place by place."""
    u = _t(spark, root).search_master.where("utt_id is not null").groupBy("utt_id").agg(F.max("form").alias("form"), F.max("pron_pred_hangul").alias("pron"))
    u = u.withColumn("f", split_ws("form")).withColumn("p", split_ws("pron"))
    same = F.size(F.filter(F.zip_with("f", "p", lambda a, b: a.eqNullSafe(b)), lambda x: x))
    return u.where(F.size("f") == F.size("p")).select("utt_id", F.size("f").cast("bigint").alias("words"), same.cast("bigint").alias("same"))


def orders_master(spark, root):
    """Orders with customer, nation and region; misses get a label."""
    t = _t(spark, root)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return o.select("o_orderkey", "o_orderstatus", F.coalesce("c_mktsegment", F.lit(dims.UNKNOWN)).alias("segment"), F.coalesce("n_name", F.lit(dims.UNKNOWN)).alias("nation"), F.coalesce("r_name", F.lit(dims.UNKNOWN)).alias("region"))


def orders_stratified(spark, root):
    o = orders_master(spark, root)
    return freq.stratified(o, ["o_orderstatus"], {"segment": F.col("segment"), "region": F.col("region"), "segment_region": F.concat_ws("×", "segment", "region")})


QUERIES = {f.__name__: f for f in (
    master, master_checks, flagship, pronunciation, spelled_roman, tagged_roman, g2p_boundary, hangul_letters, syllable_roman, categories, speakers_norm, speakers_changed, first_speakers, id_keys, labs, coverage_flags,
    coverage_summary, still_missing, recovery, length_classes, empty_analysis, session_order, keyword_context, session_offsets, session_tiles, tiers_normalized, pauses, phrases, pitch_resets, prosody_segments, boundary_tones, pitch_stats, minute_averages,
    textgrid_intervals, textgrid_labels, regex_search, hitlist, located, n_insertion, words_by_set, top_sessions, first_sessions, seeded_sample, event_props, pron_compare, orders_master, orders_stratified,
)}
