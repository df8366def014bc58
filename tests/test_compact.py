import datetime as dt
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterlake.operators.compact import consolidate, consolidated, csv_records, first_fit_decreasing, pack_manifest, textgrid_complete, textgrid_utterance

GRID = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 1\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n    class = "IntervalTier"\n    name = "words"\n    xmin = 0\n    xmax = 1\n    intervals: size = 2\n    intervals [1]:\n    xmin = 0\n    xmax = 0.5\n    text = "a""b"\n    intervals [2]:\n    xmin = 0.5\n    xmax = 1\n    text = ""\n'
SCHEMA = "path string, size_bytes bigint, modified_at timestamp_ntz, content string, bin string, layer string"
D = lambda d: dt.datetime(2026, 1, d)


def test_textgrid_completeness():
    assert textgrid_complete(GRID) and textgrid_complete(GRID.replace("\n", "\r\n")) and textgrid_complete(GRID.replace("    ", "\t"))
    assert not any(textgrid_complete(GRID[:n]) for n in range(len(GRID) - 2))
    assert not textgrid_complete("<html></html>")
    assert textgrid_utterance("a/b/S.1.1.2 (3).TextGrid") == textgrid_utterance("S.1.1.2.textgrid") == "S.1.1.2"


def test_csv_records():
    assert [u for u, _ in csv_records('﻿form,utt_id\r\n"a, b\n""c""",u1\r\nx,u2,y\r\nz')] == ["u1"]
    assert list(csv_records("")) == list(csv_records("no header\n1")) == list(csv_records("utt_id,a\n\0")) == []


@given(st.lists(st.integers(0, 120), max_size=60))
@settings(max_examples=150, deadline=None)
def test_first_fit_decreasing_is_the_plain_procedure(sizes):
    bins, room = {}, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need = min(sizes[i], 100)
        b = next((b for b, r in enumerate(room) if r >= need), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= need
        bins[i] = b
    got = first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
    assert [bins[i] for i in range(len(sizes))] == got.tolist()


def files(spark):
    h = "utt_id,form\n"
    return spark.createDataFrame(
        [
            ("l/2020/S/part-0.csv", 10, D(1), h + "u1,a\nu2,b\n", "x", "y"), ("l/old/S-1.csv", 10, D(2), h + "u1,a\nu2", "x", "y"), ("l/2020/S/S (2).csv", 10, D(3), h + "u1,new\n", "x", "y"),
            ("l/2020/_build.csv", 10, D(9), h + "u1,z\n", "x", "y"), ("l/S.csv.tmp", 10, D(9), h + "u1,z\n", "x", "y"), ("a/u1.TextGrid", 500, D(1), GRID, "x", "y"), ("b/u1 (1).textgrid", 500, D(3), GRID[:-30], "x", "y"),
            ("c/u3.TextGrid", None, None, GRID, "x", "y"), ("c/u4.TextGrid", 0, D(1), "", "x", "y"), ("c/u5.TextGrid", 0, D(1), None, "x", "y"), (None, 0, D(1), GRID, "x", "y"),
        ],
        SCHEMA,
    )


def test_consolidation(spark, tmp_path):
    want = [("search_master", "u1", "l/2020/S/S (2).csv"), ("search_master", "u2", "l/2020/S/part-0.csv"), ("textgrid_eojeol", "u1", "a/u1.TextGrid"), ("textgrid_eojeol", "u3", "c/u3.TextGrid")]
    f = files(spark)
    out, named = consolidate(f.unionByName(f), f"file://{tmp_path}/t", target_bytes=30)
    names = sorted(x for x in os.listdir(tmp_path / "t") if x.endswith(".parquet"))
    assert names == sorted(r.file for r in named.collect()) and all(r.bytes == os.path.getsize(tmp_path / "t" / r.file) for r in named.collect())
    assert sum(r.records for r in named.collect()) == len(want)
    assert sorted((r.layer, r.utt_id, r.path) for r in out.collect()) == want
    assert '"new"' in out.where("layer = 'search_master' and utt_id = 'u1'").first().payload
    with pytest.raises(RuntimeError):
        consolidate(f, f"file://{tmp_path}/t")


def test_empty(spark):
    assert consolidated(files(spark).limit(0)).count() == 0


def test_packing_covers_each_path_once(spark):
    m = spark.createDataFrame([(f"p{i}", i % 50) for i in range(500)] + [("p1", 1), (None, 3)], "path string, size_bytes bigint")
    rows = pack_manifest(m, target_bytes=100, shard_files=100).collect()
    assert sorted(r.path for r in rows) == sorted(f"p{i}" for i in range(500))
    load = {}
    for r in rows:
        load[r.bin] = load.get(r.bin, 0) + int(r.path[1:]) % 50
    assert max(load.values()) <= 100 and len(load) <= sum(load.values()) / 100 + 12


def test_many_bins_a_task_and_a_file_a_bin(spark, tmp_path):
    rows = [(f"l/S{i}.csv", 60, D(1), "utt_id,form\n" + "".join(f"u{i}.{j},x{j}\n" for j in range(5)), "x", "y") for i in range(60)]
    out, named = consolidate(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/t", target_bytes=120, task_bytes=1 << 30)
    bins = {r.bin for r in named.collect()}
    assert len(bins) == 30 and out.count() == 300 and out.select("bin").distinct().count() == 30
    assert len([x for x in os.listdir(tmp_path) if x.endswith("staging")]) == 0


def test_a_file_that_no_task_named_doesnt_count(spark, tmp_path):
    from utterlake.operators.compact import _read_back, _unnamed, _fs

    out, named = consolidate(files(spark), f"file://{tmp_path}/t")
    spark.createDataFrame([("l", "u", "p", "x", "b")], "layer string, utt_id string, path string, payload string, bin string").coalesce(1).write.parquet(f"file://{tmp_path}/extra")
    extra = next(x for x in os.listdir(tmp_path / "extra") if x.endswith(".parquet"))
    os.rename(tmp_path / "extra" / extra, tmp_path / "t" / extra)
    assert _read_back(spark, f"file://{tmp_path}/t", named).count() == 4
    fs, folder = _fs(spark, f"file://{tmp_path}/t")
    assert _unnamed(spark, fs, folder, named) == [extra]
