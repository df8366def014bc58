"""Ordered sequences and time intervals: tiling, tiers, pauses, phrases, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-6
#: Labels of silence; pause and pitch limits in seconds and semitones.
SILENCE = ["", "sil", "sp", "spn", "<eps>", "<unk>"]
IP_GAP, AP_GAP, RESET_ST, TONE_ST, LAST_GAP = 0.15, 0.05, 2.0, 1.5, 999.0


def prefix_scan(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None = None, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, position: str | None = None
) -> DataFrame:
    """Adds to each row of a sequence (keys, order): sums and maxima over the rows before it (null where there are none), values of the
    row after it (null at the end) and its position from 1.

    ``block`` is a column that never falls along the order, a number or a stretch of time. Windows then run inside blocks, and over
    one summary row per block, so a key that holds a third of all rows is spread over many tasks. Without it a key is one block.
    Null keys form a group of their own.
    """
    sums, maxes, nexts = sums or {}, maxes or {}, nexts or {}
    d = df.withColumn("_block", F.lit(0) if block is None else block)
    for name, c in {**sums, **maxes, **nexts}.items():
        d = d.withColumn(f"_v_{name}", c)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*order)
    sets = [F.sum(f"_v_{n}").over(before).alias(n) for n in sums] + [F.max(f"_v_{n}").over(before).alias(n) for n in maxes] + [F.lead(F.struct(F.col(f"_v_{n}"))).over(inside).alias(f"_x_{n}") for n in nexts]
    totals = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums] + [F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes] + [F.min_by(F.struct(F.col(f"_v_{n}")), rank).alias(f"_t_{n}") for n in nexts] + [F.count("*").alias("_rows")]
    per = d.groupBy(*keys, "_block").agg(*totals)
    over = Window.partitionBy(*keys).orderBy("_block")
    upto = over.rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.sum(f"_t_{n}").over(upto).alias(f"_b_{n}") for n in sums] + [F.max(f"_t_{n}").over(upto).alias(f"_b_{n}") for n in maxes] + [F.lead(f"_t_{n}").over(over).alias(f"_b_{n}") for n in nexts] + [F.sum("_rows").over(upto).alias("_b_rows")]
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *bases)
    d = d.select("*", *sets, *([F.row_number().over(inside).alias("_row")] if position else []))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block").eqNullSafe(F.col("_k_block"))]
    j = d.join(per, on)
    out = [F.coalesce(F.col(n) + F.col(f"_b_{n}"), F.col(n), F.col(f"_b_{n}")).alias(n) for n in sums]
    out += [F.greatest(n, f"_b_{n}").alias(n) for n in maxes]
    out += [F.coalesce(f"_x_{n}", f"_b_{n}").getField(f"_v_{n}").alias(n) for n in nexts]
    if position:
        out.append((F.coalesce("_b_rows", F.lit(0)) + F.col("_row")).cast("int").alias(position))
    return j.select(*df.columns, *out)


def running_offset(df: DataFrame, keys: list[str], order: list[str], length: str, block: Column | None = None) -> DataFrame:
    """Adds ``offset`` and ``until``: items laid end to end."""
    j = prefix_scan(df, keys, order, block, sums={"offset": F.col(length)})
    return j.withColumn("offset", F.coalesce("offset", F.lit(0))).withColumn("until", F.col("offset") + F.col(length))


def tile(df: DataFrame, keys: list[str], order: list[str], begin: str = "xmin", end: str = "xmax", text: str = "text", total: str | None = None, block: Column | None = None) -> DataFrame:
    """Intervals without overlap or gap: starts move to the latest end so far, gaps become intervals with '' and, if ``total`` names
    the full length, one fills the tail. Intervals that shrink to nothing are dropped."""
    j = prefix_scan(df, keys, order, block, maxes={"_cur": F.col(end)}, nexts={"_after": F.lit(1)} if total else None)
    j = j.withColumn("_cur", F.coalesce("_cur", F.lit(0).cast("double")))
    a = F.greatest(begin, F.col("_cur"))
    b = F.greatest(end, a)
    out = [F.struct(F.col("_cur").alias("xmin"), a.alias("xmax"), F.lit("").alias("text")), F.struct(a.alias("xmin"), b.alias("xmax"), F.col(text).alias("text"))]
    if total:
        out.append(F.struct(b.alias("xmin"), F.when(F.col("_after").isNull(), F.col(total)).otherwise(b).alias("xmax"), F.lit("").alias("text")))
    return j.select(*keys, F.inline(F.array(*out))).where(F.col("xmax") - F.col("xmin") > TINY)


def normalize_tier(df: DataFrame, keys: list[str], order: list[str], duration: str, block: Column | None = None) -> DataFrame:
    """Ends clamped to the duration, intervals of no length dropped, the tail (only) padded with ''."""
    clamped = df.withColumn("xmax", F.least("xmax", duration)).where(F.col("xmax") - F.col("xmin") > TINY)
    clamped = prefix_scan(clamped, keys, order, block, nexts={"_after": F.lit(1)})
    clamped = clamped.withColumn("_pad", F.when(F.col("_after").isNull(), F.col(duration)).otherwise(F.col("xmax")))
    rows = F.array(F.struct("xmin", "xmax", "text"), F.struct(F.col("xmax").alias("xmin"), F.col("_pad").alias("xmax"), F.lit("").alias("text")))
    return clamped.select(*keys, F.inline(rows)).where(F.col("xmax") - F.col("xmin") > TINY)


def split_tokens(value: Column, delimiter: str | None) -> Column:
    """Tokens at white space, or at a literal delimiter and trimmed."""
    if delimiter is None:
        return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda x: x != "")
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\Q" + delimiter + r"\E"), lambda x: F.trim(x)), lambda x: x != "")


def mirror_tokens(words: DataFrame, values: DataFrame, key: str, value: str, delimiter: str | None, mark: str = "[align≠]") -> DataFrame:
    """A tier with the tokens of ``value`` on the intervals of the words; silences stay blank.

    If the number of tokens isn't that of the words with content, one interval over the whole length holds the text behind a mark.
    words: key, idx, xmin, xmax, text; values: key, value, dur. Result: key, xmin, xmax, text, warned.
    """
    content = (~F.coalesce("text", F.lit("")).isin(SILENCE)).cast("int")
    inside = Window.partitionBy(key).orderBy("idx")
    w = words.select(key, "idx", "xmin", "xmax", content.alias("_sound")).withColumn("_rank", F.sum("_sound").over(inside)).withColumn("_row", F.row_number().over(inside))
    w = w.withColumn("_n", F.sum("_sound").over(Window.partitionBy(key)))
    j = w.join(values.select(key, value, "dur").withColumn("_t", split_tokens(F.col(value), delimiter)), key)
    text = F.when(F.col("_sound") == 1, F.get("_t", (F.col("_rank") - 1).cast("int"))).otherwise("")
    row = lambda a, b, t, warned: F.struct(a.alias("xmin"), b.alias("xmax"), t.alias("text"), F.lit(warned).alias("warned"))
    # where the tokens don't fit, the first word alone gives a row
    one = F.when(F.size("_t") == F.col("_n"), row(F.col("xmin"), F.col("xmax"), text, False)).when(F.col("_row") == 1, row(F.lit(0.0), F.col("dur"), F.concat(F.lit(mark), F.col(value)), True))
    return j.select(key, one.alias("_r")).where("_r is not null").select(key, "_r.*")


def with_pause(words: DataFrame, keys: list[str], begin: str = "xmin", end: str = "xmax", pitch: tuple[str, str] | None = None, block: Column | None = None) -> DataFrame:
    """Adds ``gap`` to the next word (999 after the last) and ``boundary``: IP from 0.15 s, AP from 0.05 s or a pitch reset of two semitones."""
    nexts = {"_next": F.col(begin)}
    if pitch:
        last, first = pitch
        nexts["_next_hz"] = F.col(first)
    j = prefix_scan(words, keys, [begin, end], block, nexts=nexts).withColumn("gap", F.coalesce(F.col("_next") - F.col(end), F.lit(LAST_GAP)))
    kind = F.when(F.col("gap") >= IP_GAP, "IP").when(F.col("gap") >= AP_GAP, "AP")
    if pitch:
        kind = kind.when((F.col("_next_hz") > 0) & (F.col(last) > 0) & (12 * F.log2(F.col("_next_hz") / F.col(last)) >= RESET_ST), "AP")
    return j.withColumn("boundary", kind.otherwise("")).drop(*nexts)


def numbered_phrases(words: DataFrame, keys: list[str], begin: str = "xmin", end: str = "xmax", block: Column | None = None) -> DataFrame:
    """Adds the numbers of the accent phrase (``ap``) and the intonation phrase (``ip``) that a word stands in, from 1."""
    j = prefix_scan(words, keys, [begin, end], block, sums={"ap": F.when(F.col("boundary") != "", 1).otherwise(0), "ip": F.when(F.col("boundary") == "IP", 1).otherwise(0)})
    return j.withColumn("ap", F.coalesce("ap", F.lit(0)) + 1).withColumn("ip", F.coalesce("ip", F.lit(0)) + 1)


def phrases(words: DataFrame, keys: list[str], begin: str = "xmin", end: str = "xmax", block: Column | None = None) -> DataFrame:
    """Accent phrases between boundaries, numbered, with the intonation phrase they stand in."""
    g = numbered_phrases(words, keys, begin, end, block).groupBy(*keys, "ap", "ip")
    return g.agg(F.min(begin).alias("xmin"), F.max(end).alias("xmax"), F.count("*").alias("n_words"))


def labelled_phrases(words: DataFrame, keys: list[str], tone: str, begin: str = "xmin", end: str = "xmax", block: Column | None = None) -> DataFrame:
    """(keys, ap, xmin, xmax, label): one segment per accent phrase; ``AP``, or ``IP:`` and the tone of its last word where it also ends
    an intonation phrase. words carry ``boundary`` and the column ``tone``; segments of no length are dropped."""
    g = numbered_phrases(words, keys, begin, end, block).groupBy(*keys, "ap")
    last = F.max_by(F.struct("boundary", F.coalesce(tone, F.lit("NA")).alias("tone")), F.struct(begin, end)).alias("_last")
    label = F.when(F.col("_last.boundary") == "AP", "AP").otherwise(F.concat(F.lit("IP:"), F.col("_last.tone")))
    return g.agg(F.min(begin).alias("xmin"), F.max(end).alias("xmax"), last).where(F.col("xmax") - F.col("xmin") > TINY).select(*keys, "ap", "xmin", "xmax", label.alias("label"))


def pitch_summary(pitch: DataFrame, keys: list[str], at: str = "t", hz: str = "hz") -> DataFrame:
    """Per key over its voiced samples: mean, lowest and highest pitch, their number, and the slope in semitones a second from the first
    to the last; null where there is none."""
    voiced = pitch.where(F.col(hz) > 0)
    first, last, span = F.min_by(hz, at), F.max_by(hz, at), F.max(at) - F.min(at)
    slope = F.when(span > 0, 12 * F.log2(last / first) / span)
    return voiced.groupBy(*keys).agg(F.avg(hz).alias("mean"), F.min(hz).alias("lowest"), F.max(hz).alias("highest"), F.count("*").alias("n"), slope.alias("slope"))


def speech_rate(rows: DataFrame, keys: list[str], tier_words: str = "words", tier_phones: str = "phones") -> DataFrame:
    """Interval rows (keys, tier, xmin, xmax, text) to one row per key: duration, seconds of silence between words, phones, and phones a
    second of speech (null without speech)."""
    length, silent = F.col("xmax") - F.col("xmin"), F.coalesce("text", F.lit("")).isin(SILENCE)
    g = rows.groupBy(*keys).agg(
        (F.max("xmax") - F.min("xmin")).alias("dur"),
        F.coalesce(F.sum(F.when((F.col("tier") == tier_words) & silent, length)), F.lit(0.0)).alias("pause"),
        F.count_if((F.col("tier") == tier_phones) & ~silent).alias("phones"),
    )
    return g.withColumn("rate", F.when(F.col("dur") > F.col("pause"), F.col("phones") / (F.col("dur") - F.col("pause"))))


def boundary_tone(first_hz: Column, last_hz: Column) -> Column:
    """H%, L% or F% by the movement of the last stretch of pitch, NA where it is unvoiced."""
    st = 12 * F.log2(last_hz / first_hz)
    return F.when(first_hz.isNull() | last_hz.isNull() | (first_hz <= 0) | (last_hz <= 0), "NA").when(st >= TONE_ST, "H%").when(st <= -TONE_ST, "L%").otherwise("F%")


def contained(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children (key, xmin, xmax, …) with the index of the parent interval that holds their middle; parents of a key don't overlap.

    One merge along time: parents and children stand in one sequence per key, and a child looks back to the last parent that began.
    No pairs are made. Children in no parent are left out.
    """
    at = F.struct("xmin", "xmax", "idx")
    p = parents.select(F.col(key).alias("_key"), F.col("xmin").alias("_at"), at.alias("_parent"), F.lit(None).cast(children.select(F.struct(*children.columns).alias("c")).schema["c"].dataType).alias("_child"))
    c = children.select(F.col(key).alias("_key"), ((F.col("xmin") + F.col("xmax")) / 2).alias("_at"), F.lit(None).cast(p.schema["_parent"].dataType).alias("_parent"), F.struct(*children.columns).alias("_child"))
    before = Window.partitionBy("_key").orderBy("_at", F.col("_child").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = p.unionByName(c).withColumn("_in", F.last("_parent", ignorenulls=True).over(before)).where(F.col("_child").isNotNull() & (F.col("_at") < F.col("_in.xmax")))
    return j.select("_child.*", F.col("_in.idx").alias("parent_idx"))


def shifted(children: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Intervals of an utterance in the time of its session: both ends plus the utterance's offset (key, offset). Others are left out."""
    j = children.join(offsets.select(key, "offset"), key)
    return j.withColumn("xmin", F.col("xmin") + F.col("offset")).withColumn("xmax", F.col("xmax") + F.col("offset")).drop("offset")
