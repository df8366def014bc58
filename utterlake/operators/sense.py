"""Word senses by the most frequent sense, lexicon and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_zeros(c: Column, empty: str) -> Column:
    """Without leading zeros; what is left as '' becomes ``empty`` (its value differs by source)."""
    t = F.regexp_replace(c, "^0+", "")
    return F.when(t == "", empty).otherwise(t)


def sense_distribution(norms: DataFrame) -> DataFrame:
    """norms (word, pos, sense_id, corpus_type, freq text) to one row per (word, pos): top sense and share, over the corpus type
    SXLS and over all. Placeholders and non-numeric frequencies are left out; ties go to the smaller sense."""
    n = norms.where(~F.coalesce("word", F.lit("")).isin("", "[]") & ~F.coalesce("sense_id", F.lit("")).isin("", "[]", "None"))
    n = n.withColumn("f", F.col("freq").try_cast("int")).where("f is not null")
    per = n.groupBy("word", "pos", "sense_id").agg(F.sum(F.when(F.col("corpus_type") == "SXLS", F.col("f"))).alias("sx"), F.sum("f").alias("al"))
    top = lambda c: F.min_by("sense_id", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), F.col("sense_id"))))
    share = lambda c: F.max(c) / F.sum(c)
    return per.groupBy("word", "pos").agg(top("sx").alias("sx_sense"), share("sx").alias("sx_share"), top("al").alias("all_sense"), share("al").alias("all_share"))


def sense_counts(norms: DataFrame) -> DataFrame:
    """norms (word, pos, sense_id, corpus_type, freq text) to (word, pos, sense_id, spoken, total): the counts of the corpus type SXLS and of
    all; the same rows are left out as in `sense_distribution`."""
    n = norms.where(~F.coalesce("word", F.lit("")).isin("", "[]") & ~F.coalesce("sense_id", F.lit("")).isin("", "[]", "None")).withColumn("f", F.col("freq").try_cast("bigint")).where("f is not null")
    return n.groupBy("word", "pos", "sense_id").agg(F.sum(F.when(F.col("corpus_type") == "SXLS", F.col("f")).otherwise(0)).alias("spoken"), F.sum("f").alias("total"))


def decide_keys(lexicon: DataFrame, distribution: DataFrame) -> DataFrame:
    """The decision for every (morph, tag) that the lexicon (`lexicon_senses`) or the norms (`sense_distribution`) know: morph, tag, senses,
    sense_id, confidence, method, candidates. As small as they are, so tokens never have to be cut to types for it."""
    key = [F.col("word").alias("morph"), F.col("pos").alias("tag")]
    d = lexicon.select(*key, "senses").join(distribution.select(*key, "sx_sense", "sx_share", "all_sense", "all_share"), ["morph", "tag"], "full")
    return d.select("morph", "tag", "senses", "all_sense", "all_share", decide(F.col("tag"), F.col("senses"), F.col("sx_sense"), F.col("sx_share"), F.col("all_sense"), F.col("all_share")).alias("d")).select("morph", "tag", "senses", "all_sense", "all_share", "d.*")


def with_decision(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds the decision of `decide_keys` to rows with (morph, tag); what no key knows is not_target or not_found."""
    j = df.join(decisions.withColumnRenamed("method", "_method"), ["morph", "tag"], "left")
    method = F.coalesce("_method", F.when(not_target(F.col("tag")), "not_target").otherwise("not_found"))
    blank = {c: F.coalesce(c, F.lit("")) for c in ("sense_id", "candidates")}
    return j.withColumns({**blank, "method": method}).drop("_method")


def lexicon_senses(lexicon: DataFrame) -> DataFrame:
    """(word, pos, senses): distinct senses without leading zeros, sorted as text."""
    s = lexicon.where("word is not null and pos is not null and sense_no is not null").select("word", "pos", strip_zeros(F.col("sense_no"), "1").alias("s"))
    return s.groupBy("word", "pos").agg(F.array_sort(F.collect_set("s")).alias("senses"))


def not_target(tag: Column) -> Column:
    """Particles, endings and symbols carry no sense."""
    return F.substring(tag, 1, 1).isin("J", "E", "S")


def decide(tag: Column, senses: Column, sx_sense: Column, sx_share: Column, all_sense: Column, all_share: Column) -> Column:
    """struct(sense_id, confidence, method, candidates) of a token: not_target, monosemous, ls_sxls, ls_all, ambiguous, not_found."""

    def out(sense: Column, conf: Column, method: str, cands: Column) -> Column:
        return F.struct(sense.alias("sense_id"), conf.alias("confidence"), F.lit(method).alias("method"), cands.alias("candidates"))

    no, n = F.lit(""), F.coalesce(F.size(senses), F.lit(0))
    nil = F.lit(None).cast("double")
    return (
        F.when(not_target(tag), out(no, nil, "not_target", no))
        .when(n == 1, out(F.get(senses, 0), F.lit(1.0), "monosemous", no))
        .when(sx_sense.isNotNull(), out(sx_sense, sx_share, "ls_sxls", no))
        .when(all_sense.isNotNull(), out(all_sense, all_share, "ls_all", no))
        .when(n > 1, out(no, nil, "ambiguous", F.array_join(senses, "|")))
        .otherwise(out(no, nil, "not_found", no))
    )


def numeric_senses(senses: Column) -> Column:
    """Sense ids in numeric order, non-numeric ones last."""
    keyed = F.transform(senses, lambda s: F.struct(F.coalesce(s.try_cast("int"), F.lit(999)).alias("n"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def redecide(method: Column, sense: Column, senses: Column) -> Column:
    """A second look at not_found and ambiguous tokens: struct(sense_id, method) by one (lex_mono) or the first of several (lex_first) lexicon senses."""
    again, n = method.isin("not_found", "ambiguous"), F.coalesce(F.size(senses), F.lit(0))
    return (
        F.when(again & (n == 1), F.struct(F.get(senses, 0).alias("sense_id"), F.lit("lex_mono").alias("method")))
        .when(again & (n > 1), F.struct(F.get(numeric_senses(senses), 0).alias("sense_id"), F.lit("lex_first").alias("method")))
        .otherwise(F.struct(sense.alias("sense_id"), method.alias("method")))
    )


def decide_type(tag: Column, senses: Column, all_sense: Column, all_share: Column) -> Column:
    """The decision for a dictionary entry, in an order of its own: monosemous, ls, lex_first(a|b), not_target, not_found."""
    n = F.coalesce(F.size(senses), F.lit(0))
    ordered = numeric_senses(senses)

    def out(sense: Column, conf: Column, method: Column) -> Column:
        return F.struct(sense.alias("sense_id"), conf.alias("confidence"), method.alias("method"))

    nil = F.lit(None).cast("double")
    return (
        F.when(n == 1, out(F.get(senses, 0), F.lit(1.0), F.lit("monosemous")))
        .when(all_sense.isNotNull(), out(all_sense, all_share, F.lit("ls")))
        .when(n > 1, out(F.get(ordered, 0), nil, F.concat(F.lit("lex_first("), F.array_join(ordered, "|"), F.lit(")"))))
        .when(not_target(tag), out(F.lit(""), nil, F.lit("not_target")))
        .otherwise(out(F.lit(""), nil, F.lit("not_found")))
    )


def etymology(types: Column, origins: Column) -> tuple[Column, Column]:
    """(one type or ``혼합(a|b)``, first three sorted origins) from collected sets."""
    t = F.array_sort(F.filter(types, lambda x: x != ""))
    kind = F.when(F.size(t) == 0, "").when(F.size(t) == 1, F.get(t, 0)).otherwise(F.concat(F.lit("혼합("), F.array_join(t, "|"), F.lit(")")))
    return kind, F.array_join(F.slice(F.array_sort(F.filter(origins, lambda x: x != "")), 1, 3), "|")


VERB_TAGS = ["VV", "VA", "VX", "VCP", "VCN", "XSV", "XSA"]


def pronunciation_index(lexicon: DataFrame) -> DataFrame:
    """lexicon (word, pos_tag, sense_no, pron_1) to one pronunciation per (word, pos): that of the smallest sense, ties to the smaller
    text. A verb in ``다`` also answers for its stem, after entries of that spelling. Rows without a pronunciation are left out."""
    rows = lexicon.where("coalesce(word, '') <> '' and coalesce(pron_1, '') <> ''").select("word", F.col("pos_tag").alias("pos"), F.coalesce(F.col("sense_no").try_cast("int"), F.lit(999)).alias("n"), F.col("pron_1").alias("pron"))
    is_verb = F.col("pos").isin(VERB_TAGS) & F.col("word").endswith("다") & (F.length("word") > 1)
    keys = F.array(F.struct(F.col("word").alias("word"), F.lit(0).alias("stem")), F.struct(F.expr("substring(word, 1, length(word) - 1)").alias("word"), F.lit(1).alias("stem")))
    long = rows.select("pos", "n", "pron", F.inline(F.when(is_verb, keys).otherwise(F.slice(keys, 1, 1))))
    return long.groupBy("word", "pos").agg(F.min_by("pron", F.struct("stem", "n", "pron")).alias("pron"))
