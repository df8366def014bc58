"""Small fixtures for operators whose rules SQL on the test tables can't show."""

import json

import pytest
from pyspark.sql import functions as F

from utterlake.functions.speakers import clean_label, label_number, micros, resolve_label
from utterlake.operators import coverage, dims, evaluate, freq, intervals, search, sense, tokens
from utterlake.sources import audio, corpus, textgrid
from utterlake.streaming import refresh


@pytest.mark.parametrize(
    ("label", "speaker"),
    [("SD200000001", "SD200000001"), ("[sd-200000001]:", "SD200000001"), ("SD 20 0000001", "SD200000001"), ("SD２０００００００１", "SD200000001"), ("화자 2", "B"), ("P1", "A"), ("SPK_02:", "B"), ("1:", "A"), ("화자 9", "#9"), (None, ""), (" ", ""), ("NA", "")],
)
def test_labels(spark, label, speaker):
    df = spark.createDataFrame([(label, "A|B")], "l string, ids string").withColumn("c", clean_label("l"))
    assert df.select(resolve_label(F.col("c"), label_number(F.col("c")), F.col("ids"))).first()[0] == speaker


@pytest.mark.parametrize(("text", "us"), [("76.055", 76_055_000), ("73,641", 73_641_000), ("46.560s", 46_560_000), ("20622ms", 20_622_000), ("0:37.549", 37_549_000), ("00:02:15.572", 135_572_000), (" 7 ", 7_000_000), ("NA", None), ("", None), (None, None), ("1:2:3:4", None)])
def test_times(spark, text, us):
    assert spark.createDataFrame([(text,)], "t string").select(micros("t")).first()[0] == us


def test_dims(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("b", 1, "y")], "k string, n int, v string")
    assert sorted(map(tuple, dims.last_wins(d, ["k"], ["n"]).collect())) == [("a", 2, ""), ("b", 1, "y")]
    assert sorted(map(tuple, dims.first_wins(d, ["k"], ["n"]).collect())) == [("a", 1, "x"), ("b", 1, "y")]
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    j = dims.join_with_defaults(left, dims.last_wins(d, ["k"], ["n"]), ["k"], {"v": "미상", "n": 0})
    assert sorted(map(tuple, j.collect())) == [("a", "미상", 2), ("b", "y", 1), ("c", "미상", 0)]


def test_ties_go_to_the_smaller_value(spark):
    d = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a")], "k string, v string")
    assert tuple(freq.top_value(d, ["k"], "v").first()) == ("k", "a", 2)


def test_positions_and_drop_rules(spark):
    d = spark.createDataFrame([("u", "가/VV  +/SW+5/SN //SP"), ("v", ""), ("w", None)], "utt_id string, tagged string")
    assert [tuple(r) for r in tokens.morph_positions(d).orderBy("word_idx", "morph_idx").collect()] == [("u", 1, 1, "가", "VV"), ("u", 3, 3, "5", "SN"), ("u", 4, 1, "/", "SP")]


def test_sense_cascade(spark):
    d = spark.createDataFrame(
        [("JX", ["1"], None, None, None, None), ("NNG", ["1"], "2", 0.5, "2", 0.5), ("NNG", ["1", "2"], "2", 0.75, "1", 0.5), ("NNG", [], None, None, "3", 0.5), ("NNG", ["2", "10", "x"], None, None, None, None), ("NNG", None, None, None, None, None)],
        "tag string, senses array<string>, a string, b double, c string, d double",
    )
    r = d.select(sense.decide(*[F.col(c) for c in ("tag", "senses", "a", "b", "c", "d")]).alias("d"), "senses", "tag", "c", F.col("d").alias("dd"))
    assert [tuple(x.d) for x in r.collect()] == [("", None, "not_target", ""), ("1", 1.0, "monosemous", ""), ("2", 0.75, "ls_sxls", ""), ("3", 0.5, "ls_all", ""), ("", None, "ambiguous", "2|10|x"), ("", None, "not_found", "")]
    again = r.select(sense.redecide(F.col("d.method"), F.col("d.sense_id"), F.col("senses")).alias("x")).collect()
    assert [tuple(x.x) for x in again][4:] == [("2", "lex_first"), ("", "not_found")]
    types = [tuple(x[0]) for x in d.select(sense.decide_type(F.col("tag"), F.col("senses"), F.col("c"), F.col("d"))).collect()]
    assert types[0][2] == "monosemous" and types[4] == ("2", None, "lex_first(2|10|x)")


def test_norms_drop_placeholders(spark):
    n = spark.createDataFrame([("a", "N", "2", "SXLS", "3"), ("a", "N", "1", "SXLS", "3"), ("a", "N", "1", "x", "9"), ("a", "N", "None", "x", "9"), ("[]", "N", "1", "x", "9"), ("a", "N", "3", "x", "many"), ("b", "N", "1", "x", "1")], "word string, pos string, sense_id string, corpus_type string, freq string")
    got = {r.word: tuple(r)[2:] for r in sense.sense_distribution(n).collect()}
    assert got == {"a": ("1", 0.5, "1", 12 / 15), "b": (None, None, "1", 1.0)}


def test_multisets_and_scores(spark):
    g = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("x", "a")], "k string, i string")
    o = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b"), ("y", "a")], "k string, i string")
    m = evaluate.multiset_matches(g, o, "k", "i")
    assert [tuple(r) for r in m.collect()] == [("u", 3, 3, 2)]
    assert evaluate.micro_prf(m).first().f1 == pytest.approx(2 / 3)
    assert evaluate.micro_prf(m.limit(0)).first().f1 == 0.0


WORDS = [("t", 0, 0.0, 0.4, "나는"), ("t", 1, 0.4, 0.45, ""), ("t", 2, 0.45, 1.0, "밥을")]


@pytest.mark.parametrize(
    ("value", "delimiter", "texts", "warned"),
    [("N A n EU n | p A p EU l", "|", ["N A n EU n", "", "p A p EU l"], False), ("only_one", "|", ["[align≠]only_one"], True), ("나는 바블", None, ["나는", "", "바블"], False), ("나는바블", None, ["[align≠]나는바블"], True)],
)
def test_mirrored_tier(spark, value, delimiter, texts, warned):
    w = spark.createDataFrame(WORDS, "k string, idx int, xmin double, xmax double, text string")
    v = spark.createDataFrame([("t", value, 1.0)], "k string, v string, dur double")
    got = intervals.mirror_tokens(w, v, "k", "v", delimiter).orderBy("xmin").collect()
    assert [r.text for r in got] == texts and {r.warned for r in got} == {warned}


def test_tiles_fill_gaps_and_tail(spark):
    d = spark.createDataFrame([("k", 0.5, 2.0, "a", 5.0), ("k", 1.0, 1.5, "b", 5.0), ("k", 1.8, 3.0, "c", 5.0)], "k string, xmin double, xmax double, text string, total double")
    got = [tuple(r)[1:] for r in intervals.tile(d, ["k"], ["xmin"], total="total").orderBy("xmin").collect()]
    assert got == [(0.0, 0.5, ""), (0.5, 2.0, "a"), (2.0, 3.0, "c"), (3.0, 5.0, "")]


def test_contained_phones(spark):
    p = spark.createDataFrame([("u", 0.0, 0.2, "k"), ("u", 0.2, 0.6, "a"), ("v", 0.0, 1.0, "x")], "k string, xmin double, xmax double, text string")
    w = spark.createDataFrame([("u", 1, 0.0, 0.3), ("u", 2, 0.3, 1.0)], "k string, idx int, xmin double, xmax double")
    assert sorted((r.text, r.parent_idx) for r in intervals.contained(p, w, "k").collect()) == [("a", 2), ("k", 1)]


def test_prosody(spark):
    w = spark.createDataFrame([("u", 0.0, 1.0, 100.0, 100.0), ("u", 1.04, 2.0, 113.0, 100.0), ("u", 2.06, 3.0, 100.0, 100.0), ("u", 3.2, 4.0, 100.0, 100.0)], "k string, xmin double, xmax double, hz_in double, hz_out double")
    got = intervals.with_pause(w, ["k"], pitch=("hz_out", "hz_in")).orderBy("xmin").collect()
    assert [r.boundary for r in got] == ["AP", "AP", "IP", "IP"] and got[-1].gap == 999.0
    t = spark.createDataFrame([(100.0, 109.1), (100.0, 91.0), (100.0, 101.0), (0.0, 5.0), (None, 5.0)], "a double, b double").select(intervals.boundary_tone(F.col("a"), F.col("b")))
    assert [r[0] for r in t.collect()] == ["H%", "L%", "F%", "NA", "NA"]


def test_textgrid_round_trip(spark, tmp_path):
    rows = [("f", "words", 1, 0.0, 0.5, 'a"b'), ("f", "words", 2, 0.5, 1.0, ""), ("f", "phones", 1, 0.0, 1.0, "spn")]
    df = spark.createDataFrame(rows, "path string, tier string, idx int, xmin double, xmax double, text string")
    text = textgrid.rendered(df, order=["words", "phones"])
    assert sorted(map(tuple, textgrid.intervals(text).collect())) == sorted(rows)
    (tmp_path / "S").mkdir()
    (tmp_path / "S" / "x.TextGrid").write_text(text.first().content, encoding="utf-8")
    assert textgrid.read_intervals(spark, f"file://{tmp_path}").count() == 3
    assert textgrid.unpronounced(df).first().ratio == 1.0


def test_json_corpus(spark, tmp_path):
    spk = lambda i, a: {"id": i, "age": a, "sex": "여성"}
    doc = lambda n, us, sp: {"id": f"F.{n}", "metadata": {"topic": " t ", "date": 20200101, "setting": {"relation": "친구"}, "speaker": sp}, "utterance": us}
    a = {"id": "F", "metadata": {"category": "a > b"}, "document": [doc(1, [{"id": "F.1.1.1", "speaker_id": "s", "form": " 가 ", "start": 1, "end": "x"}, {"id": "F.1.1.2", "form": " "}], [spk("s", "20대"), spk("s", "30대")]), doc(2, [], [])]}
    (tmp_path / "a.json").write_text(json.dumps(a, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text('{"id": "G", "docu', encoding="utf-8")
    (tmp_path / "c.json").write_text('{"id": "H"}', encoding="utf-8")
    f = corpus.read_dialogue(spark, f"file://{tmp_path}").cache()
    assert [(r.utt_id, r.form, r.start, r.end_sec) for r in corpus.dialogue_utterances(f).collect()] == [("F.1.1.1", "가", "1", "x")]
    assert [(r.id, r.age) for r in corpus.dialogue_speakers(f).collect()] == [("s", "20대")]
    assert sorted((r.doc_id, r.topic, r.date, r.speaker_ids) for r in corpus.dialogue_metadata(f).collect()) == [("F.1", "t", "20200101", "s|s"), ("F.2", "t", "20200101", "")]


def test_session_files(spark, tmp_path):
    d = tmp_path / "2020"
    d.mkdir()
    (d / "A.csv").write_bytes('﻿utt_id,form\r\nA.1,"x\ny"\r\n'.encode())
    (d / "B.csv").write_text("utt_id,form\nB.1,z\n")
    (d / "_failed.csv").write_text("utt_id,form\nZ,z\n")
    df = corpus.read_sessions(spark, f"file://{tmp_path}", "utt_id string, form string")
    assert sorted((r.session, r.year, r.utt_id, r.form) for r in df.collect()) == [("A", "2020", "A.1", "x\ny"), ("B", "2020", "B.1", "z")]
    assert corpus.read_sessions(spark, f"file://{tmp_path}", "utt_id string, form string", first=1).count() == 1
    assert corpus.read_sessions(spark, f"file://{tmp_path}", "utt_id string, form string", sessions=["B"]).count() == 1
    out = f"file://{tmp_path}/out"
    corpus.write_sessions(df.withColumn("session_id", F.col("session")), out)
    assert spark.read.parquet(out).where("year = 2020").count() == 2
    flat = f"file://{tmp_path}/flat"
    df.select("utt_id", "form").write.parquet(flat)
    corpus.append_new(spark.createDataFrame([("A.1", "old"), ("C.1", "new"), ("C.1", "new")], "utt_id string, form string"), flat, "utt_id")
    assert spark.read.parquet(flat).count() == 3


def test_audio_inventory(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\0\0" * 8000)
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    inv = corpus.file_inventory(spark, f"file://{tmp_path}", "*.wav")
    assert sorted((r.stem, r[1]) for r in inv.select("stem", corpus.is_broken_wav(F.col("length"))).collect()) == [("a", False), ("b", True)]
    raw = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.wav").orderBy("path")
    assert [r[0] for r in raw.select(audio.wav_seconds("content")).collect()] == [0.5, None]
    assert raw.select(coverage.length_class(corpus.pcm_seconds(F.col("length")))).first()[0] == "normal"


def test_hits_and_search(spark):
    d = spark.createDataFrame([("a.1", "a"), ("a.2", "a"), ("b.1", "b")], "utt_id string, session_id string")
    h = spark.createDataFrame([("", "a"), (None, "a"), ("a.1", "a"), ("b.9", "b")], "utt_id string, session_id string")
    assert sorted(r.utt_id for r in search.by_hitlist(d, h).collect()) == ["a.1", "a.2"]


def test_refresh_processes_each_file_once(spark, tmp_path):
    src, sink, ck = (f"file://{tmp_path}/{x}" for x in ("src", "sink", "ck"))
    one = spark.range(3).withColumn("t", F.lit("x"))
    one.write.parquet(src)
    run = lambda: refresh.refresh(spark, src, "id bigint, t string", lambda b: b.groupBy("t").count(), sink, ck)
    assert run() == 1 and run() == 0
    one.write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(sink).agg(F.sum("count")).first()[0] == 6


def test_event_windows(spark, tmp_path):
    src = f"file://{tmp_path}/ev"
    spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id*20,0) as ts, 'a' as k from range(6)").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, k string").parquet(src)
    q = refresh.windowed_counts(s, "ts", ["k"], "1 hour", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("select * from windows").collect()) == [3, 3]


def test_pronunciation_index(spark):
    lex = spark.createDataFrame([("먹다", "VV", "001", "먹따"), ("먹다", "VV", "002", "x"), ("값", "NNG", "001", "갑"), ("먹", "VV", "009", "y"), ("빈", "NNG", "1", "")], "word string, pos_tag string, sense_no string, pron_1 string")
    assert {(r.word, r.pos): r.pron for r in sense.pronunciation_index(lex).collect()} == {("먹다", "VV"): "먹따", ("먹", "VV"): "y", ("값", "NNG"): "갑"}


def test_norm_table(spark):
    n = spark.createDataFrame([("가", "N", "3.0", "0.5", "all"), ("가", "N", "1", "0", "child"), ("나", "N", "many", "x", "all")], "WORD string, POS_TAG string, COUNT string, LOG10 string, src string")
    assert sorted(map(tuple, freq.norm_table(n, ["all", "child"], "all").collect())) == [("가", "N", 3, 1, 0.5), ("나", "N", 0, 0, None)]


def test_stitched_session(spark):
    u = spark.createDataFrame([("s", 1, "a", 2.0), ("s", 2, "b", 3.0)], "s string, n int, utt_id string, dur double")
    at = intervals.running_offset(u, ["s"], ["n"], "dur")
    w = spark.createDataFrame([("a", 0.5, 1.0, "x"), ("b", 0.5, 1.0, "y"), ("c", 0.0, 1.0, "z")], "utt_id string, xmin double, xmax double, text string")
    assert sorted((r.xmin, r.text) for r in intervals.shifted(w, at, "utt_id").collect()) == [(0.5, "x"), (2.5, "y")]


def test_preflight(spark, tmp_path):
    from utterlake.catalog import Catalog

    spark.range(1).withColumn("a", F.lit(1)).write.parquet(f"file://{tmp_path}/t.parquet")
    c = Catalog(spark, f"file://{tmp_path}")
    assert c.verdict({"t": ["a", "b"], "u": ["x"]}) == (False, {"t": ["b"], "u": ["x"]})
    assert c.verdict({"t": ["a"], "u": ["x"]}, frozenset({"u"})) == (True, {"u": ["x"]})
    with pytest.raises(KeyError):
        c.table("_comment")
