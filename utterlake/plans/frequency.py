"""Reference queries: tokens, frequency dictionaries, gold norms and senses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterlake.catalog import Catalog
from utterlake.functions.hangul import romanized, syllable_codes
from utterlake.functions.speakers import with_speaker
from utterlake.functions.text import split_ws
from utterlake.operators import coverage, dims, evaluate, freq, nested, norms, sense, tokens
from utterlake.session import stored

YEARS = [str(y) for y in range(2020, 2026)]
SPECIAL = ["777", "888", "999"]  # fixed values: sense codes that name no sense
SPOKEN, WRITTEN = "구어", "문어"


def utterances(spark: SparkSession, root: str) -> DataFrame:
    """One record per utterance of bareun_raw: the last row loaded, ties to the greater values."""
    u = Catalog(spark, root).bareun_raw.where("utt_id is not null").select("utt_id", "form", "tagged", "speaker_id", "n_morphs", "loaded_at")
    return dims.last_wins(u, ["utt_id"], ["loaded_at", "form", "tagged", "speaker_id", "n_morphs"]).drop("loaded_at")


def morph_positions(spark, root):
    return tokens.packed_positions(utterances(spark, root), ["utt_id"])


def morph_freq(spark, root):
    return freq.frequency(morph_positions(spark, root), ["morph", "tag"])


def morph_freq_by_year(spark, root):
    m = morph_positions(spark, root).withColumn("year", tokens.year_of("utt_id"))
    return freq.pivot_frequency(m, ["morph", "tag"], "year", YEARS)


def eojeol_freq(spark, root):
    return freq.frequency(tokens.packed_pairs(utterances(spark, root)), ["surface", "analysis"], "n")


def eojeol_top_analysis(spark, root):
    return freq.top_value(tokens.packed_pairs(utterances(spark, root)), ["surface"], "analysis", "top_analysis")


def type_token_summary(spark, root):
    return morph_freq(spark, root).agg(F.sum("freq").alias("tokens"), F.count("*").alias("types"))


def token_freq(spark, root):
    d = Catalog(spark, root).documents
    return freq.frequency(d.select(F.explode(split_ws("text")).alias("token")), ["token"])


def top_tokens(spark, root):
    """The 30 most frequent words, as a report."""
    return token_freq(spark, root).orderBy(F.desc("freq"), "token").limit(30)


def split_modes(spark, root):
    d = Catalog(spark, root).documents
    return d.select("doc_id", F.size(split_ws("text")).cast("bigint").alias("words"), F.size(F.split("text", "[ ]")).cast("bigint").alias("pieces"))


def live(df: DataFrame) -> DataFrame:
    """Rows of a dimension that aren't deleted."""
    return df.where("deleted_at is null")


def _strata(spark, root):
    """Tokens counted per speaker and session before the dimensions are met, so joins see counts and not tokens."""
    t = Catalog(spark, root)
    u = with_speaker(utterances(spark, root).withColumn("session_id", tokens.session_of("utt_id")), t.file_meta, to="id")
    m = tokens.packed_positions(u, ["session_id", "id"]).groupBy("morph", "tag", "id", F.col("session_id").alias("file_id")).agg(F.count("*").alias("n"))
    m = m.withColumn("year", tokens.year_of("file_id"))
    spk = dims.last_wins(live(t.speakers_normalized).select("year", "id", "sex_norm", "age_norm", "loaded_at"), ["year", "id"], ["loaded_at", "sex_norm", "age_norm"])
    meta = dims.last_wins(live(t.file_meta).select("file_id", "category", "loaded_at", "doc_id"), ["file_id"], ["loaded_at", "doc_id", "category"]).withColumn("reg", dims.register("category"))
    m = dims.join_with_defaults(m, spk, ["year", "id"], {"sex_norm": dims.UNKNOWN, "age_norm": dims.UNKNOWN})
    m = dims.join_with_defaults(m, meta, ["file_id"], {"reg": dims.UNKNOWN})
    cols = {"reg": F.col("reg"), "sex": F.col("sex_norm"), "age": F.col("age_norm"), "sex_age": F.concat_ws("×", "sex_norm", "age_norm")}
    return m, cols


def morph_stratified(spark, root):
    m, cols = _strata(spark, root)
    return freq.stratified(m, ["morph", "tag"], cols, "n")


def strata_totals(spark, root):
    m, cols = _strata(spark, root)
    return freq.strata_totals(m, cols, "n")


def morph_dispersion(spark, root):
    m = morph_positions(spark, root).withColumn("doc", tokens.session_of("utt_id"))
    return freq.dispersion(m, ["morph", "tag"], "doc")


def gold_documents(spark, root, *layers: str) -> DataFrame:
    return nested.typed_documents(nested.newest_readable(Catalog(spark, root).sxml), layers or tuple(nested.LAYERS))


def _stored_gold(spark, root) -> DataFrame:
    """The parsed gold, written down: queries that read it several times parse it once."""
    return stored(gold_documents(spark, root, "word", "mp", "wsd"), "gold")


def gold_mp(spark, root):
    return nested.flatten_layer(gold_documents(spark, root, "mp"), "mp")


def gold_wsd(spark, root):
    return nested.flatten_layer(gold_documents(spark, root, "wsd"), "wsd")


def gold_dp(spark, root):
    return nested.flatten_layer(gold_documents(spark, root, "dp"), "dp")


def gold_za(spark, root):
    """Restored parts of sentences with the predicate they belong to and the first antecedent."""
    return nested.flatten_layer(gold_documents(spark, root, "za"), "za")


def gold_srl(spark, root):
    return nested.flatten_layer(gold_documents(spark, root, "srl"), "srl")


def gold_words(spark, root):
    return nested.flatten_layer(gold_documents(spark, root, "word"), "word")


def gold_index(spark, root):
    return nested.flatten_sentences(gold_documents(spark, root, "word"))


def gold_arguments(spark, root):
    return nested.flatten_arguments(gold_documents(spark, root, "srl"))


def gold_membership(spark, root):
    """Whether a file of the metadata is in the gold, as ``True`` or ``False``."""
    files = Catalog(spark, root).file_meta.where("file_id is not null").select("file_id").distinct()
    g = gold_index(spark, root).select(tokens.session_of("sentence_id").alias("file_id"))
    f = coverage.with_presence(files, "file_id", gold=g)
    return f.select("file_id", F.when(F.col("gold"), "True").otherwise("False").alias("in_gold"))


def _type(c: str):
    return F.when(F.col(c).startswith("SDRW"), SPOKEN).otherwise(WRITTEN)


def _ml_morphs(gold):
    m = nested.flatten_layer(gold, "mp").where("coalesce(form, '') <> ''").withColumn("corpus_type", _type("sentence_id"))
    return freq.frequency(m, ["form", "label", "corpus_type"])


def ml_morph_freq(spark, root):
    return _ml_morphs(gold_documents(spark, root, "mp"))


def _ml_words(gold):
    s = nested.flatten_analyses(gold).withColumn("corpus_type", _type("sentence_id"))
    return freq.frequency(s.where("coalesce(word_surface, '') <> ''"), ["word_surface", "morpheme_analysis", "corpus_type"])


def ml_word_freq(spark, root):
    """Words with the analysis that the MP entries naming them give, in their order; words without entries have ''."""
    return _ml_words(gold_documents(spark, root, "word", "mp"))


def _wsd(gold):
    w = nested.flatten_layer(gold, "wsd").where("coalesce(form, '') <> '' and sense_id is not null")
    return w.withColumn("sense_id", sense.strip_zeros(F.col("sense_id"), "0")).where(~F.col("sense_id").isin(SPECIAL))


def ml_sense_freq(spark, root):
    w = _wsd(gold_documents(spark, root, "wsd")).withColumn("corpus_type", _type("sentence_id"))
    return freq.frequency(w.withColumnRenamed("form", "word"), ["word", "sense_id", "pos", "corpus_type"])


def norm_join(spark, root):
    """The morph dictionary beside the gold norms, 0 where they lack an entry."""
    n = ml_morph_freq(spark, root).withColumns({"morph": F.col("form"), "tag": F.col("label"), "roman": F.lit(""), "mfa": F.lit("")})
    n = norms.split_counts(n, ["morph", "tag"], "freq_ml", SPOKEN).select("morph", "tag", "freq_ml_spoken", "freq_ml_written")
    return norms.chain(morph_freq(spark, root), (n, ["morph", "tag"]))


def fallback_analysis(spark, root):
    """The analysis of each word of the forms: from the corpus, else from the gold, else ''."""
    a = eojeol_top_analysis(spark, root).select(F.col("surface").alias("token"), "top_analysis")
    g = freq.top_value(ml_word_freq(spark, root).where("morpheme_analysis <> ''"), ["word_surface"], "morpheme_analysis", "gold_analysis").select(F.col("word_surface").alias("token"), "gold_analysis")
    t = utterances(spark, root).select(F.explode(split_ws("form")).alias("token")).distinct()
    j = t.join(a, "token", "left").join(g, "token", "left")
    return j.select("token", dims.first_filled(F.col("top_analysis"), F.col("gold_analysis")).alias("analysis"))


def _ls(wsd):
    """The sense norms of the later years of the gold, as the rows of a norm file."""
    late = wsd.withColumn("year", tokens.year_of("sentence_id")).where("year > '2022'")
    return late.groupBy(F.col("form").alias("word"), "pos", "sense_id", F.when(F.col("year") == "2023", "SXLS").otherwise("other").alias("corpus_type")).agg(F.count("*").cast("string").alias("freq"))


def _norms(gold):
    w = _wsd(gold)
    lexicon = w.where(tokens.year_of("sentence_id") <= "2022").select(F.col("form").alias("word"), "pos", F.col("sense_id").alias("sense_no"))
    return sense.lexicon_senses(lexicon), sense.sense_distribution(_ls(w))


def sense_norms(spark, root):
    return _norms(_stored_gold(spark, root))[1]


def _decisions(gold):
    return sense.decide_keys(*_norms(gold))


def _typed_counts(spark, root, *by):
    """Tokens counted by type before they meet the norms."""
    m = morph_positions(spark, root).withColumn("year", tokens.year_of("utt_id"))
    return m.groupBy("morph", "tag", *by).agg(F.count("*").alias("n"))


def sense_layer(spark, root):
    """Every token with its sense by the cascade. Each key of the norms is decided once, tokens are joined to the decisions as they are read."""
    t = sense.with_decision(morph_positions(spark, root), _decisions(_stored_gold(spark, root)))
    return t.select("utt_id", "word_idx", "morph_idx", "morph", "tag", "sense_id", "confidence", "method", "candidates")


def sense_redecided(spark, root):
    t = sense.with_decision(_typed_counts(spark, root), _decisions(_stored_gold(spark, root)))
    r = t.withColumn("r", sense.redecide(F.col("method"), F.col("sense_id"), F.col("senses")))
    return r.groupBy("morph", "tag", F.col("r.sense_id").alias("sense_id"), F.col("r.method").alias("method"), "candidates").agg(F.sum("n").alias("n"))


def method_share(spark, root):
    t = sense.with_decision(_typed_counts(spark, root), _decisions(_stored_gold(spark, root)))
    return freq.with_share(t.groupBy("method").agg(F.sum("n").alias("n")), "n")


def sense_dictionary(spark, root):
    types = _typed_counts(spark, root).withColumnRenamed("n", "freq")
    known = _decisions(_stored_gold(spark, root)).select("morph", "tag", "senses", "all_sense", "all_share")
    types = types.join(known, ["morph", "tag"], "left")
    return types.withColumn("d", sense.decide_type(F.col("tag"), F.col("senses"), F.col("all_sense"), F.col("all_share"))).select("morph", "tag", "freq", "d.*")


def sense_freq_by_year(spark, root):
    """Senses by year with their confidence, beside the counts of the norms; a token without a sense has none there."""
    gold = _stored_gold(spark, root)
    t = sense.with_decision(_typed_counts(spark, root, "year"), _decisions(gold))
    f = freq.pivot_frequency(t, ["morph", "tag", "sense_id", "method"], "year", YEARS, "freq_", "n", F.max("confidence").alias("confidence"))
    ls = sense.sense_counts(_ls(_wsd(gold))).where("sense_id <> ''").select(F.col("word").alias("morph"), F.col("pos").alias("tag"), "sense_id", F.col("spoken").alias("freq_ls_spoken"), F.col("total").alias("freq_ls_all"))
    return norms.chain(f, (ls, ["morph", "tag", "sense_id"]))


def _spelled(c):
    """Romanized spelling as norms write it: ``G EO - S EU``; '' for what isn't Hangul throughout."""
    return F.when(F.col(c).rlike("^[가-힣]+$"), romanized(syllable_codes(F.col(c)), spelled=True, syllable=" - ")).otherwise("")


def _norm_files(spark, root):
    """The gold read as the files of norms: (MP morphs, LS morphs, MP words, LS words, lexicon, norms of four groups of speakers)."""
    gold = _stored_gold(spark, root)
    year = tokens.year_of("sentence_id")
    mp = nested.flatten_layer(gold, "mp").where("coalesce(form, '') <> '' and label is not null")
    mp = mp.select(F.col("form").alias("morph"), F.col("label").alias("tag"), year.alias("year"), F.lit(1).alias("freq"), _spelled("form").alias("roman"), _spelled("form").alias("mfa"), (F.when(year <= "2021", SPOKEN).otherwise(WRITTEN)).alias("corpus_type"))
    wsd = _wsd(gold).where("pos is not null").select(F.col("form").alias("morph"), F.col("pos").alias("tag"), year.alias("year"), F.lit(1).alias("freq"), _spelled("form").alias("roman"), _spelled("form").alias("mfa"), F.when(year == "2023", "SXLS").otherwise("other").alias("corpus_type"), "sense_id")
    word = nested.flatten_layer(gold, "word").where("coalesce(form, '') <> ''").select(F.col("form").alias("eojeol"), year.alias("year"), F.lit(1).alias("freq"), _spelled("form").alias("roman"), _spelled("form").alias("mfa"), F.when(year <= "2021", SPOKEN).otherwise(WRITTEN).alias("corpus_type"))
    # of the forms that a norm lacks, a lexicon has some: here the words of the gold, with the class of their tag as a kind of origin
    lexicon = wsd.select(F.col("morph").alias("word"), F.col("tag").alias("pos"), F.substring("tag", 1, 1).alias("word_type"), F.col("sense_id").alias("origin"), "roman", "mfa")
    group = F.when(F.col("year") <= "2020", "young").when(F.col("year") <= "2021", "child").when(F.col("year") <= "2022", "elderly").otherwise("all")
    four = mp.groupBy("morph", "tag", group.alias("src")).agg(F.count("*").alias("c")).select(F.col("morph").alias("WORD"), F.col("tag").alias("POS_TAG"), F.col("c").cast("string").alias("COUNT"), F.round(F.log10("c"), 4).cast("string").alias("LOG10"), "src")
    return gold, mp.where("year <= '2022'"), wsd, word, lexicon, four


def morph_dictionary(spark, root):
    """The morph dictionary: counts by year, the norms beside them, the sense of the type, etymology, romanization by fallback and IPA."""
    gold, mp, wsd, _, lexicon, four = _norm_files(spark, root)
    m = freq.pivot_frequency(_typed_counts(spark, root, "year"), ["morph", "tag"], "year", YEARS, "freq_", "n")
    key = ["morph", "tag"]
    ml = norms.split_counts(_ml_morphs(gold).select(F.col("form").alias("morph"), F.col("label").alias("tag"), "corpus_type", "freq", F.lit("").alias("roman"), F.lit("").alias("mfa")), key, "ml", SPOKEN).drop("ml_roman", "ml_mfa")
    groups = freq.norm_table(four, ["all", "young", "child", "elderly"], "all").withColumnsRenamed({"word": "morph", "pos": "tag", "log10": "four_log10"})
    roman, etym = norms.lexicon_entries(lexicon)
    known = _decisions(gold).select(*key, "senses", "all_sense", "all_share")
    j = norms.chain(
        m, (norms.split_counts(mp, key, "mp", SPOKEN), key), (norms.split_counts(wsd, key, "ls", "SXLS"), key), (ml, key), (groups, key),
        (etym.withColumnsRenamed({"word": "morph", "pos": "tag"}), key), (roman.withColumnRenamed("word", "morph"), ["morph"]),
    ).join(known, key, "left")
    rom, mfa = norms.roman_chain("mp", "ls", "lex")
    d = sense.decide_type(F.col("tag"), F.col("senses"), F.col("all_sense"), F.col("all_share"))
    own = [c for c in j.columns if not c.endswith(("_roman", "_mfa")) and c not in ("senses", "all_sense", "all_share")]
    j = j.withColumns({"d": d, "roman": rom, "roman_mfa": mfa})
    # the norm's total of all senses is its spoken part and the rest
    j = j.select(*[(F.col("ls_spoken") + F.col("ls_written")).alias("ls_all") if c == "ls_written" else c for c in own], F.col("d.sense_id").alias("sense_id"), F.col("d.confidence").alias("sense_conf"), F.col("d.method").alias("sense_method"), "roman", "roman_mfa")
    return j.withColumn("ipa", norms.mfa_to_ipa(F.col("roman_mfa")))


def eojeol_dictionary(spark, root):
    """The dictionary of words: counts by year over all their analyses, the most frequent one, the norms of words, romanization and IPA."""
    _, _, _, word, _, _ = _norm_files(spark, root)
    u = utterances(spark, root)
    pairs = tokens.packed_pairs(u, keep=["utt_id"]).withColumn("year", tokens.year_of("utt_id"))
    n = pairs.groupBy("surface", "analysis", "year").agg(F.count("*").alias("n"))
    by_year = freq.pivot_frequency(n, ["surface"], "year", YEARS, "freq_", "n")
    top = freq.top_value(n, ["surface"], "analysis", "top_analysis", weight="n").select("surface", "top_analysis")
    mp = norms.split_counts(word.where("year <= '2022'"), ["eojeol"], "mp", SPOKEN)
    ls = norms.split_counts(word.where("year > '2022'").withColumn("corpus_type", F.when(F.col("year") == "2023", "SXLS").otherwise("other")), ["eojeol"], "ls", "SXLS")
    j = norms.chain(by_year.join(top, "surface").withColumnRenamed("surface", "eojeol"), (mp, ["eojeol"]), (ls, ["eojeol"]))
    rom, mfa = norms.roman_chain("mp", "ls")
    j = j.withColumns({"roman": rom, "roman_mfa": mfa}).drop("mp_roman", "mp_mfa", "ls_roman", "ls_mfa")
    return j.withColumn("ipa", norms.mfa_to_ipa(F.col("roman_mfa")))


def etymology(spark, root):
    """Single or mixed kinds of a brand's parts and the first three of its types."""
    p = Catalog(spark, root).part.groupBy("p_brand").agg(F.collect_set(F.substring_index("p_type", " ", 1)).alias("k"), F.collect_set("p_type").alias("o"))
    kind, first = sense.etymology(F.col("k"), F.col("o"))
    return p.select("p_brand", kind.alias("kind"), first.alias("origins"))


def _scored(spark, root):
    """(gold, our utterances that it has): the corpus is cut to them before anything is taken apart."""
    gold = _stored_gold(spark, root)
    ids = nested.flatten_sentences(gold).select(F.col("sentence_id").alias("utt_id")).distinct()
    return gold, utterances(spark, root).join(ids, "utt_id", "left_semi")


def _matches(gold, ours):
    g = nested.flatten_layer(gold, "mp").select(F.col("sentence_id").alias("utt_id"), F.concat_ws("/", "form", "label").alias("item"), F.col("item_no").alias("place"))
    o = tokens.packed_positions(ours, ["utt_id"])
    place = F.row_number().over(Window.partitionBy("utt_id").orderBy("word_idx", "morph_idx"))  # within an utterance
    o = o.select("utt_id", F.concat_ws("/", "morph", "tag").alias("item"), place.alias("place"))
    return evaluate.multiset_matches(g, o, "utt_id", "item", "place")


def morph_matches(spark, root):
    return _matches(*_scored(spark, root))


def morph_scores(spark, root):
    """Precision, recall and F1 of the corpus analysis against the gold MP layer: of sentences spelled alike in both, of others, and of all."""
    gold, ours = _scored(spark, root)
    forms = nested.flatten_sentences(gold).groupBy(F.col("sentence_id").alias("utt_id")).agg(F.max("form").alias("g")).join(ours.select("utt_id", "form"), "utt_id")
    forms = forms.select("utt_id", (F.trim(F.coalesce("g", F.lit(""))) == F.trim(F.coalesce("form", F.lit("")))).cast("string").alias("same_form"))
    m = _matches(gold, ours).join(forms, "utt_id")
    return evaluate.micro_prf(m, ["same_form"]).withColumn("same_form", F.coalesce("same_form", F.lit("total")))


def sense_accuracy(spark, root):
    """Gold senses against ours by method and in total; of several tokens of an utterance the first counts."""
    gold, own = _scored(spark, root)
    g = _wsd(gold).select(F.col("sentence_id").alias("utt_id"), F.col("form").alias("morph"), F.col("pos").alias("tag"), F.col("sense_id").alias("gold"))
    first = tokens.packed_positions(own, ["utt_id"]).groupBy("utt_id", "morph", "tag").agg(F.lit(True).alias("there"))
    # a decision hangs on the type alone, so any token of the type is the first
    ours = sense.with_decision(first, _decisions(gold)).select("utt_id", "morph", "tag", "sense_id", "method")
    j = g.join(ours, ["utt_id", "morph", "tag"], "left").select(F.coalesce("method", F.lit("absent")).alias("m"), (F.col("gold") == F.coalesce("sense_id", F.lit(""))).alias("ok"))
    return evaluate.accuracy_by(j, "m", "ok").withColumn("method", F.coalesce("method", F.lit("total")))


QUERIES = {f.__name__: f for f in (
    morph_positions, morph_freq, morph_freq_by_year, eojeol_freq, eojeol_top_analysis, type_token_summary, token_freq, top_tokens, split_modes, morph_stratified, strata_totals, morph_dispersion,
    gold_mp, gold_wsd, gold_dp, gold_za, gold_srl, gold_words, gold_index, gold_arguments, gold_membership, morph_dictionary, eojeol_dictionary, ml_morph_freq, ml_word_freq, ml_sense_freq, norm_join, fallback_analysis, sense_norms, sense_layer, sense_redecided, method_share, sense_dictionary,
    sense_freq_by_year, etymology, morph_scores, morph_matches, sense_accuracy,
)}
