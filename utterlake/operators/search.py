"""Pattern search, context around hits, files of hits, boundary candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterlake.operators.intervals import prefix_scan
from utterlake.operators.tokens import session_of


def regex_search(df: DataFrame, column: str, pattern: str, **equal: object) -> DataFrame:
    """Rows whose column matches a pattern and whose other columns have the given values; the latter reach the scan."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    return df.where(F.col(column).rlike(pattern))


def context(df: DataFrame, hit: Column, key: str, order: list[str], n: int, block: Column | None = None) -> DataFrame:
    """Rows within n places of a hit in their session, clipped at its ends. Places are counted in blocks (`intervals.prefix_scan`); each
    hit names its 2 n + 1 places, and an equi-join on session and place finds them, so a long session isn't one task."""
    placed = prefix_scan(df.withColumn("is_hit", hit), [key], order, block, position="position")
    near = placed.where("is_hit").select(F.col(key).alias("_key"), F.explode(F.sequence(F.col("position") - n, F.col("position") + n)).alias("_at")).distinct()
    return placed.join(near, F.col(key).eqNullSafe(F.col("_key")) & (F.col("position") == F.col("_at")), "left_semi")


def by_hitlist(df: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows that a hit list (utt_id, session_id) names; a hit without utt_id names its whole session."""
    whole = hits.where(F.coalesce("utt_id", F.lit("")) == "").select("session_id").distinct()
    single = hits.where(F.coalesce("utt_id", F.lit("")) != "").select("utt_id").distinct()
    a = df.join(whole, "session_id", "left_semi")
    return a.unionByName(df.join(single, "utt_id", "left_semi").join(whole, "session_id", "left_anti"))


def locate(utts: DataFrame, files: DataFrame) -> DataFrame:
    """utts (utt_id) with the best file of each: files (utt_id, layer, priority, path); lower priority wins, then the smaller path."""
    best = files.groupBy("utt_id").agg(F.min_by(F.struct("layer", "path"), F.struct("priority", "path")).alias("b"))
    j = utts.join(best, "utt_id", "left")
    return j.select(*utts.columns, F.coalesce("b.layer", F.lit("")).alias("layer"), F.coalesce("b.path", F.lit("")).alias("path"), F.when(F.col("b").isNull(), "not found").otherwise("").alias("note"))


def layer_path(utt_id: str, layer: str, ext: str) -> Column:
    u = F.col(utt_id)
    return F.concat_ws("/", F.lit(layer), F.concat(F.lit("20"), F.substring(session_of(u), 5, 2)), session_of(u), F.concat(u, F.lit("." + ext)))


def n_insertion_candidates(morphs: DataFrame) -> DataFrame:
    """Pairs of neighbouring morphs of an utterance at which an n may be inserted: the left one ends in a coda, the right one begins with
    i or y. morphs: utt_id, word_idx, morph_idx, morph, tag; right ones that are particles or endings are left out."""
    w = Window.partitionBy("utt_id").orderBy("word_idx", "morph_idx")
    pairs = morphs.select("utt_id", "word_idx", "morph_idx", "morph", "tag", F.lead("morph").over(w).alias("right"), F.lead("tag").over(w).alias("right_tag"), F.lead("word_idx").over(w).alias("right_word"))
    code = lambda c: F.ascii(c) - 44032
    last, first = F.substring("morph", -1, 1), F.substring("right", 1, 1)
    hangul = last.rlike("^[가-힣]$") & first.rlike("^[가-힣]$")
    coda = code(last) % 28 > 0
    vowel = F.floor(code(first) % 588 / 28)
    open_ = (F.floor(code(first) / 588) == 11) & vowel.isin(2, 3, 6, 7, 12, 17, 20)
    kind = F.when(F.col("word_idx") == F.col("right_word"), "inside").otherwise("across")
    return pairs.where(hangul & coda & open_ & ~F.substring("right_tag", 1, 1).isin("J", "E")).select("utt_id", "word_idx", "morph_idx", "morph", "tag", "right", "right_tag", kind.alias("boundary"))
