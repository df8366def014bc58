"""Speech transcripts into clean, ordered speaker turns.

Order, carried start times and turn numbers are prefix computations over a session. They are made in two levels: inside blocks of
bounded size, and over one summary row per block; so a session that holds a third of all utterances is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterlake.functions.speakers import clean_label, label_number, micros, resolve_label, session_speakers
from utterlake.functions.text import INVISIBLE, WS, split_ws
from utterlake.session import stored

#: Utterances per block of numbers, seconds per block of time, utterances that one decoding task takes of a run.
BLOCK_UTTERANCES, BLOCK_SECONDS, PIECE = 512, 600, 256
#: Smoothing of the participants' language profiles, and the prior of the transitions (counts of staying and changing).
ALPHA, STAY_PRIOR, CHANGE_PRIOR = 0.5, 2.0, 1.0

_TIME = r"\d{1,3}(?::\d{1,2}){1,2}(?:[.,]\d+)?"
#: Notes of sounds and time marks stand in brackets or between asterisks.
_NOTE = r"\(\([^()]*\)\)|（（[^（）]*））|<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|\([^()]*\)|（[^（）]*）|【[^【】]*】|\*[^*]*\*"
#: Hesitation sounds, each also drawn out.
_HESITATION = r"아+|어+|으*음+|으+|흐*음+|흠+|그+|엄+|에+|uh+m*|um+|er+m*|ah+|hm+|mm+"
_EDGE = r"[^\p{L}\p{N}&\s]*"


def clean_text(c: Column) -> Column:
    """A transcript without time marks, notes of sounds and hesitation sounds, with single spaces; '' if nothing is left."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), f"[{INVISIBLE}]+", "")
    t = F.regexp_replace(t, _NOTE, " ")
    t = F.regexp_replace(t, rf"(?<![\d:.]){_TIME}(?![\d:])", " ")
    t = F.regexp_replace(t, f"[{WS}]+", " ")
    t = F.regexp_replace(t, r"(?<!\S)(\p{L}{1,3})[-–]+ (?=\1)", "")  # a word broken off and begun again
    t = F.regexp_replace(t, rf"(?i)(?<!\S){_EDGE}(?:{_HESITATION}){_EDGE}(?!\S)", "")
    return F.trim(F.regexp_replace(t, " +", " "))


def has_content(clean: Column) -> Column:
    return clean.rlike(r"[\p{L}\p{N}]")


def utterances(search_master: DataFrame, dialogue_json: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per utterance of search_master: session_id, num, utt_id, label, start (µs), content flag and, if asked, its clean text.

    Both tables are cut down and joined as one union under one aggregation, combined before the shuffle. The transcript is that of
    dialogue_json, or of search_master where it has none.
    """
    num = lambda c: F.element_at(F.split(c, r"\."), -1).try_cast("bigint")
    text = clean_text(F.col("original_form"))
    content = has_content(text).cast("int")
    base = [F.col("session_id"), num(F.col("utt_id")).alias("num"), F.col("utt_id")]
    none = lambda t: F.lit(None).cast(t)
    sm = search_master.where("utt_id is not null and session_id is not null").select(
        *base, F.coalesce("speaker_id", F.lit("")).alias("label"), micros("start").alias("start"), F.lit(1).alias("here"), content.alias("own"), none("int").alias("other"), *([text.alias("own_text"), none("string").alias("other_text")] if with_text else [])
    )
    dj = dialogue_json.where("utt_id is not null").withColumn("session_id", F.substring_index("utt_id", ".", 1)).select(
        *base, none("string").alias("label"), none("bigint").alias("start"), F.lit(0).alias("here"), none("int").alias("own"), F.when(F.col("original_form").isNotNull(), content).alias("other"), *([none("string").alias("own_text"), F.when(F.col("original_form").isNotNull(), text).alias("other_text")] if with_text else [])
    )
    merged = sm.unionByName(dj).groupBy("session_id", "num", "utt_id").agg(
        F.max("here").alias("here"), F.max("label").alias("label"), F.min("start").alias("start"), F.coalesce(F.max("other"), F.max("own")).alias("content"), *([F.coalesce(F.max("other_text"), F.max("own_text")).alias("text")] if with_text else [])
    )
    return merged.where("here = 1").drop("here")


def _carry(blocks: DataFrame, value: str, order: str) -> Column:
    before = Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(before)


def ordered(utts: DataFrame, file_meta: DataFrame) -> DataFrame:
    """Adds the speaker and the effective start: an utterance without a start takes that of the utterance numbered just before it."""
    u = utts.withColumn("nblock", F.floor(F.coalesce("num", F.lit(-1)) / BLOCK_UTTERANCES))
    inside = Window.partitionBy("session_id", "nblock").orderBy("num", "utt_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("known", F.last("start", ignorenulls=True).over(inside))
    per_block = u.groupBy("session_id", "nblock").agg(F.max_by("start", F.when(F.col("start").isNotNull(), F.struct("num", "utt_id"))).alias("last_start"))
    per_block = per_block.withColumn("carried", _carry(per_block, "last_start", "nblock")).join(session_speakers(file_meta), "session_id", "left")
    u = u.join(per_block.select("session_id", "nblock", "carried", "speaker_ids"), ["session_id", "nblock"])
    clean = clean_label("label")
    speaker = resolve_label(clean, label_number(clean), F.col("speaker_ids"))
    return u.withColumn("at", F.coalesce("known", "carried", F.lit(-1).cast("bigint"))).withColumn("speaker", speaker).drop("label", "known", "carried", "nblock")


def numbered(utts: DataFrame) -> DataFrame:
    """Utterances with content, each with the number of its turn: one more wherever the speaker changes."""
    u = utts.where("content = 1").withColumn("tblock", F.floor(F.col("at") / (BLOCK_SECONDS * 1_000_000)))
    inside = Window.partitionBy("session_id", "tblock").orderBy("at", "num", "utt_id")
    before = F.lag("speaker").over(inside)
    # within a block: turns begun so far, the first utterance not counted
    u = u.withColumn("change", F.when(before.isNull() | (before == F.col("speaker")), 0).otherwise(1))
    u = u.withColumn("turn", F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    key = F.struct("at", "num", "utt_id")
    blocks = u.groupBy("session_id", "tblock").agg(F.min_by("speaker", key).alias("first"), F.max_by("speaker", key).alias("last"), F.max("turn").alias("changes"))
    over = Window.partitionBy("session_id").orderBy("tblock")
    new = F.when(F.lag("last").over(over).isNull() | (F.lag("last").over(over) != F.col("first")), 1).otherwise(0)
    blocks = blocks.withColumn("new", new)
    upto = F.sum(F.col("new") + F.col("changes")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.select("session_id", "tblock", (upto - F.col("changes")).alias("base"))
    return u.join(blocks, ["session_id", "tblock"]).withColumn("turn_no", (F.col("base") + F.col("turn")).cast("int")).drop("change", "turn", "base", "content")


def turn_table(utts: DataFrame) -> DataFrame:
    """Merges the utterances of each turn; a turn is first merged within its block of time, then over blocks. A column ``label`` is
    kept: '' for a turn none of whose utterances has one."""
    key = F.struct("at", "num", "utt_id")
    with_text = "text" in utts.columns
    label = [F.max("label").alias("label")] if "label" in utts.columns else []
    part = utts.groupBy("session_id", "tblock", "turn_no").agg(
        F.max("speaker").alias("speaker_id"), F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"), *label, *([F.array_sort(F.collect_list(F.struct("at", "num", "utt_id", "text"))).alias("texts")] if with_text else [])
    )
    if with_text:
        part = part.withColumn("texts", F.struct("first", F.array_join(F.transform("texts", lambda x: x["text"]), " ").alias("text")))
    whole = part.groupBy("session_id", "turn_no").agg(
        F.max("speaker_id").alias("speaker_id"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").cast("int").alias("n_utterances"), *label, *([F.array_sort(F.collect_list("texts")).alias("texts")] if with_text else [])
    )
    text = [F.array_join(F.transform("texts", lambda x: x["text"]), " ").alias("text")] if with_text else []
    return whole.select("session_id", "turn_no", "speaker_id", F.col("first.utt_id").alias("first_utt_id"), F.col("last.utt_id").alias("last_utt_id"), F.when(F.col("first.at") >= 0, F.col("first.at") / 1e6).alias("start"), "n_utterances", *(["label"] if label else []), *text)


def transitions(k: int, stay: float) -> np.ndarray:
    move = np.full((k, k), np.log((1 - stay) / max(1, k - 1)))
    np.fill_diagonal(move, np.log(stay))
    return move


def viterbi(emission: np.ndarray, before: int, after: int, stay: float, first: int = -1, last: int = -1) -> np.ndarray:
    """The likeliest states of a chain: log emissions (steps x states), the state before and after (-1: unknown), probability of staying;
    first and last fix the states of its own ends (-1: free)."""
    n, k = emission.shape
    if k == 1:
        return np.zeros(n, dtype=int)
    move = transitions(k, stay)
    score = emission[0] + (move[before] if before >= 0 else -np.log(k))
    if first >= 0:
        score = np.where(np.arange(k) == first, score, -np.inf)
    back = np.zeros((n, k), dtype=int)
    for t in range(1, n):
        via = score[:, None] + move
        back[t] = via.argmax(0)
        score = via.max(0) + emission[t]
    if after >= 0:
        score = score + move[:, after]
    path = np.empty(n, dtype=int)
    path[-1] = last if last >= 0 else score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def best_scores(emission: np.ndarray, stay: float) -> np.ndarray:
    """Of a piece of a chain: the score of the likeliest path from each first state (row) to each last state (column)."""
    k = emission.shape[1]
    move = transitions(k, stay)
    best = np.full((k, k), -np.inf)
    np.fill_diagonal(best, emission[0])
    for e in emission[1:]:
        best = (best[:, :, None] + move).max(1) + e
    return best


def piece_ends(scores: list[np.ndarray], before: int, after: int, stay: float) -> list[tuple[int, int]]:
    """The first and last state of each piece on the likeliest path of the whole chain: pieces are joined in max-plus, one matrix each."""
    k = len(scores[0])
    move = transitions(k, stay)
    enter = move[before] if before >= 0 else np.full(k, -np.log(k))
    firsts, froms = [], []  # by last state of a piece: its first state; by first state: the last state of the piece before
    for i, m in enumerate(scores):
        if i:
            via = leave[:, None] + move
            froms.append(via.argmax(0))
            enter = via.max(0)
        total = enter[:, None] + m
        firsts.append(total.argmax(0))
        leave = total.max(0)
    last = int((leave + move[:, after] if after >= 0 else leave).argmax())
    ends = []
    for i in range(len(scores) - 1, -1, -1):
        first = int(firsts[i][last])
        ends.append((first, last))
        if i:
            last = int(froms[i - 1][first])
    return ends[::-1]


def stay_probability(turns: DataFrame) -> DataFrame:
    """One row: how likely the next utterance with a label is by the same speaker, smoothed."""
    t = turns.where("speaker_id <> ''").agg(F.coalesce(F.sum("n_utterances"), F.lit(0)).alias("n"), F.count("*").alias("t"))
    return t.select(((F.col("n") - F.col("t") + STAY_PRIOR) / (F.col("n") + STAY_PRIOR + CHANGE_PRIOR)).alias("stay"))


def infer_labels(utts: DataFrame, turns: DataFrame, words: DataFrame, file_meta: DataFrame) -> DataFrame:
    """(session_id, turn_no, utt_id, likely_speaker) for the utterances without a label.

    A hidden Markov model: states are the participants of the session (listed in file_meta or heard with a label), emissions their language profiles (smoothed word counts of
    what they say with a label in this session), transitions how often speakers change in the corpus. A label is certain, so
    the chain falls apart at labelled utterances: each run between two of them is decoded by itself, from the speaker before to
    the speaker after. A run that crosses a block of time or is longer than PIECE is decoded in pieces, with the result of the whole:
    each piece is summed up by the best score between each pair of its end states, the run's pieces (one row each) give the end
    states of the likeliest path, and each piece is decoded between them. Of equally likely paths any one may be taken.
    """
    # turn numbers are dense, so a turn's neighbours are met by an equi-join on the number: no window over a session
    unlabelled_turns = turns.where("speaker_id = ''").select("session_id", "turn_no")
    open_sessions = unlabelled_turns.select("session_id").distinct()
    beside = lambda step, name: turns.select("session_id", (F.col("turn_no") + step).alias("turn_no"), F.col("speaker_id").alias(name))
    near = unlabelled_turns.join(beside(1, "before"), ["session_id", "turn_no"], "left").join(beside(-1, "after"), ["session_id", "turn_no"], "left")
    # participants: those listed, in the list's order, then others whose labels are heard in the session
    named = session_speakers(file_meta).join(open_sessions, "session_id", "left_semi").select("session_id", F.posexplode(F.transform(F.split("speaker_ids", r"\|"), F.btrim)).alias("place", "person"))
    named = named.unionByName(utts.where("speaker <> ''").join(open_sessions, "session_id", "left_semi").select("session_id", F.lit(1 << 30).alias("place"), F.col("speaker").alias("person")))
    named = named.where("person <> ''").groupBy("session_id", "person").agg(F.min("place").alias("place"))
    people = named.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "person"))), lambda x: x["person"]).alias("people"))
    unlabelled = utts.where("speaker = ''").select("session_id", "turn_no", "tblock", "at", "num", "utt_id")
    in_block = Window.partitionBy("session_id", "turn_no", "tblock")
    ends = unlabelled.groupBy("session_id", "turn_no").agg(F.min("tblock").alias("first_block"), F.max("tblock").alias("last_block"))
    unlabelled = unlabelled.withColumn("rank", F.row_number().over(in_block.orderBy("at", "num", "utt_id")) - 1).withColumn("last_rank", F.max("rank").over(in_block))
    runs = near.join(people, "session_id").join(ends, ["session_id", "turn_no"]).join(unlabelled, ["session_id", "turn_no"])
    heard = words.join(open_sessions, "session_id", "left_semi")
    spoken = utts.select("session_id", "utt_id", "speaker").join(heard, ["session_id", "utt_id"]).select("session_id", "utt_id", "speaker", F.explode("words").alias("word"))
    counts = spoken.where("speaker <> ''").groupBy("session_id", "speaker", "word").agg(F.count("*").alias("c"))
    totals = counts.groupBy("session_id", "speaker").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
    asked = spoken.where("speaker = ''").select("session_id", "utt_id", "word").join(people, "session_id").select("session_id", "utt_id", "word", F.explode("people").alias("speaker"))
    scored = (
        asked.join(totals, ["session_id", "speaker"], "left")
        .join(counts, ["session_id", "speaker", "word"], "left")
        .withColumn("ll", F.log((F.coalesce("c", F.lit(0)) + ALPHA) / (F.coalesce("total", F.lit(0)) + ALPHA * (F.coalesce("types", F.lit(0)) + 1000))))
        .groupBy("session_id", "utt_id", "speaker").agg(F.sum("ll").alias("ll"))
        .groupBy("session_id", "utt_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "ll"))).alias("ll"))
    )
    decode_in = runs.join(scored, ["session_id", "utt_id"], "left").join(F.broadcast(stay_probability(turns)))
    piece, last_piece = F.floor(F.col("rank") / PIECE), F.floor(F.col("last_rank") / PIECE)
    # whether the run goes on beyond the piece, at either side
    begins, ends_ = (F.col("tblock") == F.col("first_block")) & (piece == 0), (F.col("tblock") == F.col("last_block")) & (piece == last_piece)
    decode_in = decode_in.select(
        "session_id", "turn_no", "tblock", piece.alias("piece"), "rank", "utt_id", F.when(begins, F.col("before")).alias("before"), F.when(ends_, F.col("after")).alias("after"), (begins & ends_).alias("whole"),
        "people", "stay", F.transform("people", lambda p: F.coalesce(F.try_element_at("ll", p), F.lit(0.0))).alias("ll"),
    )
    decode_in = stored(decode_in, "runs")  # read for the scores of pieces and again to decode them
    key = ["session_id", "turn_no", "tblock", "piece"]
    names = "session_id string, turn_no int, tblock bigint, piece bigint"
    scores = in_groups(decode_in.where("not whole"), key, ["rank"], _summed_up, f"{names}, states_before int, states_after int, stay double, scores array<double>")
    ends = in_groups(scores, key[:2], ["tblock", "piece"], _joined, f"{names}, first_state int, last_state int")
    fixed = decode_in.join(ends, key, "left").fillna(-1, ["first_state", "last_state"])
    return in_groups(fixed, key, ["rank"], _decoded, "session_id string, turn_no int, utt_id string, likely_speaker string")


def in_groups(df: DataFrame, key: list[str], order: list[str], of_group: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``of_group`` over the rows of each group, in order. Rows come sorted and are cut where the key changes, so a batch holds many groups
    and a group costs no call of its own; what is held is one group, which is bounded here (a piece, or the pieces of a run)."""
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])
        group: list[dict] = []
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                if group and any(row[k] != group[0][k] for k in key):
                    out += of_group(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], target.field(c).type) for c in columns], schema=target)
        if group:
            out = of_group(group)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], target.field(c).type) for c in columns], schema=target)

    return df.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_PIECE_KEY = ("session_id", "turn_no", "tblock", "piece")


def _state(name: str | None, people: list[str]) -> int:
    return people.index(name) if name in people else -1


def _summed_up(rows: list[dict]) -> list[dict]:
    r = rows[0]
    scores = best_scores(np.array([x["ll"] for x in rows], dtype=float), r["stay"])
    return [{**{c: r[c] for c in _PIECE_KEY}, "states_before": _state(r["before"], r["people"]), "states_after": _state(rows[0]["after"], r["people"]), "stay": r["stay"], "scores": scores.ravel().tolist()}]


def _joined(rows: list[dict]) -> list[dict]:
    k = math.isqrt(len(rows[0]["scores"]))
    found = piece_ends([np.array(x["scores"]).reshape(k, k) for x in rows], rows[0]["states_before"], rows[-1]["states_after"], rows[0]["stay"])
    return [{**{c: x[c] for c in _PIECE_KEY}, "first_state": a, "last_state": b} for x, (a, b) in zip(rows, found, strict=True)]


def _decoded(rows: list[dict]) -> list[dict]:
    r = rows[0]
    path = viterbi(np.array([x["ll"] for x in rows], dtype=float), _state(r["before"], r["people"]), _state(r["after"], r["people"]), r["stay"], r["first_state"], r["last_state"])
    return [{"session_id": x["session_id"], "turn_no": x["turn_no"], "utt_id": x["utt_id"], "likely_speaker": r["people"][i]} for x, i in zip(rows, path, strict=True)]


def _read(search_master: DataFrame, dialogue_json: DataFrame, file_meta: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utterances with their turns, turns, inferred labels)."""
    # both are read many times below: written down, they cut the lineage and are computed once
    utts = stored(numbered(ordered(utterances(search_master, dialogue_json, with_text), file_meta)), "utterances")
    turns = stored(turn_table(utts), "turns")
    words = search_master.where("utt_id is not null").groupBy("session_id", "utt_id").agg(F.max("form").alias("form"))
    words = words.select("session_id", "utt_id", split_ws("form").alias("words"))
    return utts, turns, infer_labels(utts, turns, words, file_meta)


def speaker_turns(search_master: DataFrame, dialogue_json: DataFrame, file_meta: DataFrame, with_text: bool = False) -> DataFrame:
    """The turns of every session: session_id, turn_no, speaker_id, first_utt_id, last_utt_id, start, n_utterances[, text], likely_speaker.

    speaker_id is the resolved label, '' for a turn without one; likely_speaker is speaker_id or, for such a turn, whom the hidden
    Markov model takes most of its utterances to be by. Utterances that hold nothing but time marks, sound notes and hesitations
    are left out first. Rows with the same utt_id are one utterance; rows without utt_id or session_id are left out; an unreadable
    or missing start is carried from the utterance numbered before, or comes first in the session; a session without a list in
    file_meta and without any label has no participants to choose from, so likely_speaker stays ''.
    """
    _, turns, inferred = _read(search_master, dialogue_json, file_meta, with_text)
    likely = inferred.groupBy("session_id", "turn_no").agg(F.mode("likely_speaker", True).alias("likely"))
    # one aggregation puts both together; every turn passes the model's stage
    both = turns.withColumn("likely", F.lit(None).cast("string")).unionByName(likely, allowMissingColumns=True)
    both = both.groupBy("session_id", "turn_no").agg(*[F.max(c).alias(c) for c in both.columns if c not in ("session_id", "turn_no")])
    return both.withColumn("likely_speaker", F.coalesce(F.when(F.col("speaker_id") != "", F.col("speaker_id")), "likely", F.lit(""))).drop("likely")


def completed_turns(search_master: DataFrame, dialogue_json: DataFrame, file_meta: DataFrame, with_text: bool = False) -> DataFrame:
    """The columns of `speaker_turns`, but turns change wherever the completed speaker does.

    The inferred label is put on each utterance without one, then turns are numbered and merged again. likely_speaker is the
    completed speaker of the turn; speaker_id is '' where no utterance of it has a label.
    """
    utts, _, inferred = _read(search_master, dialogue_json, file_meta, with_text)
    utts = utts.drop("turn_no", "tblock").withColumnRenamed("speaker", "label").withColumn("content", F.lit(1))
    # only utterances without a label meet the inferred ones
    known = utts.where("label <> ''").withColumn("speaker", F.col("label"))
    other = utts.where("label = ''").join(inferred.select("session_id", "utt_id", F.col("likely_speaker").alias("speaker")), ["session_id", "utt_id"], "left").fillna("", ["speaker"])
    # read twice by `numbered`
    turns = turn_table(numbered(stored(known.unionByName(other), "completed")))
    return turns.withColumnRenamed("speaker_id", "likely_speaker").withColumnRenamed("label", "speaker_id").select("session_id", "turn_no", "speaker_id", "first_utt_id", "last_utt_id", "start", "n_utterances", *(["text"] if with_text else []), "likely_speaker")
