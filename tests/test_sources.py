"""Audio headers, alignment databases, sinks."""

import json
import os
import sqlite3
import wave

import pytest
from pyspark.sql import functions as F

from utterlake.sources import alignment, audio, sinks


def test_headers_are_those_of_a_wav(spark, tmp_path):
    pcm = bytes(range(256)) * 25
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000), w.writeframes(pcm)
    want = (tmp_path / "a.wav").read_bytes()
    got = spark.createDataFrame([(bytearray(pcm),)], "pcm binary").select(F.concat(audio.wav_header(F.length("pcm")), "pcm").alias("w")).first().w
    assert bytes(got) == want
    assert spark.createDataFrame([(bytearray(want),)], "w binary").select(audio.header_seconds(F.col("w"))).first()[0] == pytest.approx(0.2)
    assert audio.chunk_seconds(want) == pytest.approx(0.2)
    # a chunk of odd size before the data
    other = want[:36] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + want[36:]
    rows = spark.createDataFrame([(1, bytearray(other)), (2, bytearray(b"RIFF")), (3, None), (4, bytearray(want[:-3200]))], "i int, w binary")
    assert {r.i: r.s for r in rows.select("i", audio.wav_seconds("w").alias("s")).collect()} == {1: 0.2, 2: None, 3: None, 4: 0.1}


def test_session_audio(spark):
    clips = spark.createDataFrame([("s", 2, bytearray(b"cd"), 16000), ("s", 1, bytearray(b"ab"), 16000), ("s", 3, None, 16000), ("t", 1, bytearray(b"ab"), 8000), ("t", 2, bytearray(b"ab"), 16000)], "session_id string, num int, pcm binary, rate int")
    got = audio.session_audio(clips).collect()
    assert [(r.session_id, bytes(r.wav[44:])) for r in got] == [("s", b"abcd")]


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "a.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE utterance (id INTEGER PRIMARY KEY, file_id INT, speaker_id INT, begin REAL, end REAL)")
    con.execute("CREATE TABLE file (id INTEGER PRIMARY KEY, name TEXT)")
    con.execute("CREATE TABLE speaker (id INTEGER PRIMARY KEY, name TEXT)")
    con.execute("CREATE TABLE word (id INTEGER PRIMARY KEY, word TEXT)")
    con.execute("CREATE TABLE word_interval (id INTEGER PRIMARY KEY, utterance_id INT, begin REAL, end REAL, word_id INT)")
    con.executemany("INSERT INTO utterance VALUES (?, ?, ?, 0, 1.5)", [(i, i % 3, i % 2 if i % 5 else None) for i in range(1, 51)])
    con.executemany("INSERT INTO file VALUES (?, ?)", [(0, "f0"), (1, "f1")])
    con.executemany("INSERT INTO speaker VALUES (?, ?)", [(0, "a")])
    con.executemany("INSERT INTO word VALUES (?, ?)", [(1, "밥"), (2, "<eps>")])
    con.executemany("INSERT INTO word_interval VALUES (?, 1, ?, ?, ?)", [(1, 0, 0.5, 1), (2, 0.5, 1, 2), (3, 1, 1.5, 9)])
    con.execute("CREATE TABLE empty_one (id INT)")
    con.commit()
    con.close()
    return f"file://{path}"


def test_alignment_database(spark, database):
    read = lambda t, schema, **kw: alignment.read_table(spark, database, t, schema, rows_per_task=7, **kw)
    u = read("utterance", "id bigint, file_id bigint, speaker_id bigint, begin double, end double")
    assert sorted(r.id for r in u.collect()) == list(range(1, 51))
    assert read("utterance", "id bigint", where="end > 2").count() == 0 and read("empty_one", "id bigint").count() == 0
    j = alignment.utterance_files(u, read("file", "id bigint, name string"), read("speaker", "id bigint, name string"))
    assert {(r.id, r.file, r.speaker) for r in j.collect()} == {(i, f"f{i % 3}", "a" if i % 5 and i % 2 == 0 else None) for i in range(1, 51) if i % 3 < 2}
    w = alignment.labelled_intervals(read("word_interval", "utterance_id bigint, begin double, end double, word_id bigint"), read("word", "id bigint, word string"), "word_id", "word")
    assert sorted((r.xmin, r.text) for r in w.collect()) == [(0.0, "밥"), (0.5, ""), (1.0, "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2020, "a", 1), (2020, "b", 5), (2021, "c", 3), (2022, "d", 4)], "year int, w string, n int")
    sinks.write_dictionary(df, f"file://{tmp_path}/d", [F.desc("n"), "w"], single=True)
    (name,) = [x for x in os.listdir(tmp_path / "d") if x.endswith(".csv")]
    assert (tmp_path / "d" / name).read_text().split() == ["year,w,n", "2020,b,5", "2022,d,4", "2021,c,3", "2020,a,1"]
    assert sinks.write_tables(df, {"one": lambda d: d.select("w"), "two": lambda d: d.where("n > 3")}, f"file://{tmp_path}/t") == {"one": 4, "two": 2}
    folder = f"file://{tmp_path}/p"
    df.write.partitionBy("year").parquet(folder)
    before = {y: os.listdir(tmp_path / "p" / f"year={y}") for y in (2020, 2021)}
    new = spark.createDataFrame([(2020, "b", 5), (2020, "a", 1), (2021, "c", 9), (2023, "e", 1)], "year int, w string, n int")
    assert sinks.rewrite_changed(spark.read.parquet(folder), new, "year", folder) == ["2021", "2022", "2023"]
    assert sorted(map(tuple, spark.read.parquet(folder).select("year", "w", "n").collect())) == sorted(map(tuple, new.collect()))
    assert os.listdir(tmp_path / "p" / "year=2020") == before[2020] and os.listdir(tmp_path / "p" / "year=2021") != before[2021]
    assert sinks.rewrite_changed(spark.read.parquet(folder), new, "year", folder) == []


def test_report_and_manifest(spark, tmp_path):
    checks = spark.createDataFrame([(10, 0, 3)], "n_rows int, lost int, warned int")
    got = sinks.build_report(spark, f"file://{tmp_path}/r.json", checks, ["lost"], {"master": "v1"})
    assert got["verdict"] == "ok" and json.loads((tmp_path / "r.json").read_text())["totals"]["n_rows"] == 10
    assert sinks.build_report(spark, f"file://{tmp_path}/r.json", checks, ["lost", "warned"], {})["failed"] == ["warned"]
    files = spark.createDataFrame([("u1", "x", 2, "b"), ("u1", "x", 1, "a")], "utt_id string, layer string, priority int, path string")
    hits = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("",), (None,)], "utt_id string")
    assert sorted((r.utt_id, r.path, r.note) for r in sinks.manifest(hits, files).collect()) == [("u1", "a", ""), ("u2", "", "not found")]
