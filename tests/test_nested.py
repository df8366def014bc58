import datetime as dt
import json

import pyarrow as pa

from utterlake.operators.nested import flatten_arguments, flatten_layer, flatten_links, flatten_analyses, flatten_sentences, id_lists, newest_readable, typed_documents

T = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]


def body(sentences, **kw):
    return json.dumps({"id": "F", "document": {"id": "F.1", "sentence": sentences}, **kw}, ensure_ascii=False)


SENTENCES = [
    {
        "id": "s1",
        "word": [{"id": 1, "form": "나는"}, {"id": 2, "form": "간다"}],
        "MP": [{"form": "나", "label": "NP", "word_id": 1}, {"form": "는", "label": "JX", "word_id": "1"}, None],
        "WSD": {"form": "나", "sense_id": 3, "pos": "NP"},
        "SRL": {"predicate": [{"form": "간다", "word_id": 2}, {"form": "x", "word_id": 9}], "argument": {"form": "나는", "word_id": [1, 1, "2"]}, "adjunct": [{"form": "y"}, {"form": "z", "word_id": 7}]},
    },
    {"id": "s2", "MP": None, "SRL": []},
]


def table(spark, rows):
    return spark.createDataFrame(rows, "file_id string, received_at timestamp_ntz, body string, doc int, h string")


def test_links(spark):
    rows = [("F", T[0], body([{"id": "old"}]), 1, "x"), ("F", T[1], "﻿" + body(SENTENCES), 1, "x"), ("F", T[2], body(SENTENCES)[:-9], 1, "x"), ("F", T[2], None, 1, "x"), (None, T[2], body([]), 1, "x"), ("G", T[0], "[1]", 1, "x"), ("H", None, body([{"id": "h"}]), 1, "x")]
    got = sorted(tuple(r) for r in flatten_links(table(spark, rows + rows[:2])).collect())
    assert got == sorted(
        [("sentence", "s1", 0, 0, ""), ("sentence", "s2", 0, 0, ""), ("sentence", "h", 0, 0, ""), ("mp", "s1", 1, 0, "1"), ("mp", "s1", 2, 0, "1"), ("mp", "s1", 3, 0, ""), ("wsd", "s1", 1, 0, ""), ("srl", "s1", 1, 0, "2")]
        + [("srl_arg", "s1", 1, 1, "1"), ("srl_arg", "s1", 1, 1, "2"), ("srl_arg", "s1", 1, 2, ""), ("srl_arg", "s1", 1, 3, "7")]
    )


def test_full_tables_and_empty(spark):
    t = typed_documents(newest_readable(table(spark, [("F", T[0], body(SENTENCES), 0, "")])))
    assert [tuple(r) for r in flatten_layer(t, "mp").where("item_no < 3").orderBy("item_no").collect()] == [("F", 1, 1, "s1", 1, "1", "나", "NP"), ("F", 1, 1, "s1", 2, "1", "는", "JX")]
    got = [(r.arg_no, r.role, r.form, r.word_ids, r.predicate_word_id) for r in flatten_arguments(t).orderBy("arg_no").collect()]
    assert got == [(1, "argument", "나는", "1|2", "2"), (2, "adjunct", "y", "", "2"), (3, "adjunct", "z", "7", "2")]
    assert flatten_links(table(spark, [])).count() == 0
    assert flatten_layer(typed_documents(newest_readable(table(spark, []))), "za").count() == 0


def test_sentences_without_id_stay_apart(spark):
    """Slices, nulls and things that aren't objects keep their places; children carry file, document and sentence."""
    many = [None, 7, *({"MP": {"form": str(i), "word_id": i}} for i in range(200))]
    docs = json.dumps({"document": [{"sentence": many}, None, {"sentence": {"id": "z", "MP": [{"form": "q"}]}}]})
    t = typed_documents(newest_readable(table(spark, [("F", T[0], docs, 0, "")])))
    keys = [tuple(r) for r in flatten_sentences(t).select("doc_no", "sent_no", "sentence_id").orderBy("doc_no", "sent_no").collect()]
    assert keys == [(1, i + 3, "") for i in range(200)] + [(3, 1, "z")]
    got = {(r.doc_no, r.sent_no): r.form for r in flatten_layer(t, "mp").collect()}
    assert got == {**{(1, i + 3): str(i) for i in range(200)}, (3, 1): "q"}


def test_zero_anaphora_and_dependencies(spark):
    s = {"id": "s", "DP": [{"word_id": 1, "word_form": "a", "head": -1, "label": "VP"}], "ZA": {"predicate": {"form": "p", "word_id": 4}, "ellipsis": [{"restored": {"form": "r", "type": "t"}, "antecedent": {"form": "x", "sentence_id": "s0"}}, {"antecedent": []}]}}
    t = typed_documents(newest_readable(table(spark, [("F", T[0], body([s]), 0, "")])))
    assert [tuple(r)[4:] for r in flatten_layer(t, "dp").collect()] == [(1, "1", "a", "-1", "VP")]
    assert sorted(tuple(r)[4:] for r in flatten_layer(t, "za").collect()) == [(1, 1, "p", "4", "r", "t", "x", "s0"), (1, 2, "p", "4", None, None, None, None)]


def test_analyses_follow_entries(spark):
    s = {"id": "s", "word": [{"id": 1, "form": "나는"}, {"id": 2, "form": "x"}, {"form": "y"}], "MP": [{"form": "나", "label": "NP", "word_id": 1}, {"form": "z", "label": "Q"}, {"form": "는", "label": "JX", "word_id": "1"}]}
    t = typed_documents(newest_readable(table(spark, [("F", T[0], body([s]), 0, ""), ("G", T[0], body([]), 0, "")])))
    assert [(r.word_surface, r.morpheme_analysis) for r in flatten_analyses(t).collect()] == [("나는", "나/NP+는/JX"), ("x", ""), ("y", "")]


def test_id_lists():
    x = pa.array(["1", None, "", '[1, "2", null, 1]', "[", "[]", "a b"])
    assert id_lists(x).to_pylist() == [["1"], [], [], ["1", "2"], ["["], [], ["a b"]]
    assert id_lists(pa.array([], pa.string())).to_pylist() == []
