import datetime as dt

from utterlake.operators.counts import SignedCounts, row_changes
from utterlake.operators.orphans import advance, existence_deltas, fold, orphan_keys, orphan_report, reference_deltas

D = lambda d: dt.datetime(2026, 1, d)
SM = "utt_id string, year string, session_id string, speaker_id string, loaded_at timestamp_ntz, key string, state string"


def report(spark, sm, br=(), fm=(), sp=()):
    return sorted(
        (r.ref_field, r.row_key, r.state)
        for r in orphan_report(
            spark.createDataFrame(list(sm), SM),
            spark.createDataFrame(list(br), "utt_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, refs int"),
            spark.createDataFrame(list(fm), "file_id string, speaker_ids string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"),
            spark.createDataFrame(list(sp), "year string, id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"),
        ).collect()
    )


def test_states(spark):
    s = "SDRW2000000001"
    u = lambda n, label, day: (f"{s}.1.1.{n}", "2020", s, label, D(day), "k", "s")
    sm = [u(1, "SD200000001", 5), u(1, "SD200000001", 3), u(2, "화자 2", 5), u(3, None, 5), u(4, "[sd-200000009]:", 5), u(5, "P1", 5), (None, "2020", None, "SD200000001", D(1), "", "")]
    br = [(f"{s}.1.1.1", D(1), None, 0), (f"{s}.1.1.2", D(1), D(2), 0), (f"{s}.1.1.3", D(1), D(2), 0), (f"{s}.1.1.3", D(4), None, 0), (f"{s}.1.1.4", D(6), None, 0)]
    fm = [(s, "SD200000001|SD200000002", D(4), None)]
    sp = [("2020", "SD200000001", D(4), None), ("2020", "SD200000002", D(1), D(2)), ("2021", "SD200000009", D(1), None)]
    got = report(spark, sm, br, fm, sp)
    assert got == sorted(
        [("utt_id", f"{s}.1.1.2", "deleted"), ("utt_id", f"{s}.1.1.4", "late"), ("utt_id", f"{s}.1.1.5", "missing"), ("file_id", s, "late"), ("speaker_id", f"{s}.1.1.1", "late"), ("speaker_id", f"{s}.1.1.2", "deleted"), ("speaker_id", f"{s}.1.1.4", "missing")]
    )


def test_empty(spark):
    assert report(spark, []) == []


REF, ROW = "ref_field string, key string, at timestamp_ntz", "ref_field string, key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def test_deltas_in_steps_give_the_state_of_one_pass(spark):
    ref = spark.createDataFrame([("f", "a", D(1)), ("f", "a", D(2)), ("f", "b", D(1)), ("f", None, D(1))], REF)
    rows = spark.createDataFrame([("f", "a", D(3), None), ("f", "c", D(1), None)], ROW)
    step = fold(reference_deltas(ref))
    step = advance(step, existence_deltas(rows))
    once = fold(reference_deltas(ref).unionByName(existence_deltas(rows)))
    assert sorted(map(str, step.collect())) == sorted(map(str, once.collect()))
    assert sorted((r.key, r.state) for r in orphan_keys(step).collect()) == [("a", "late"), ("b", "missing")]
    gone = spark.createDataFrame([("f", "b", D(1), -1)], REF + ", sign int")
    assert [r.key for r in orphan_keys(advance(step, reference_deltas(gone))).collect()] == ["a"]


def test_load_delete_reload(spark):
    """What exists is taken back by its deletion and comes again with a reload, as in one pass over the table of each day."""
    ref = reference_deltas(spark.createDataFrame([("f", k, D(3)) for k in "abcd"], REF))
    rows = spark.createDataFrame([("f", "a", D(1), D(5)), ("f", "a", D(7), None), ("f", "b", D(1), D(2)), ("f", "c", D(2), None), ("f", "c", D(1), D(6)), ("f", "d", None, D(8))], ROW)
    state, before = fold(ref), None
    for day in (1, 2, 4, 5, 6, 7, None):
        until = D(day) if day else None
        state = advance(state, existence_deltas(row_changes(rows, before, until)))
        once = fold(ref.unionByName(existence_deltas(row_changes(rows, None, until))))
        assert sorted(map(str, state.collect())) == sorted(map(str, once.collect()))
        before = until
        got = {r.key: r.state for r in orphan_keys(state).collect()}
        if day == 4:
            assert got == {"b": "deleted"}
        if day == 5:
            assert got == {"a": "deleted", "b": "deleted"}
        if day == 7:
            assert got == {"a": "late", "b": "deleted"}
    assert got == {"a": "late", "b": "deleted", "d": "deleted"}


def test_store_takes_a_delta_once_and_merges_layers(spark, tmp_path):
    store = SignedCounts(spark, f"file://{tmp_path}/s", "k string, n bigint, m bigint", ["k"])
    assert store.read().count() == 0
    df = lambda rows: spark.createDataFrame(rows, "k string, n int, m int")
    assert store.apply(df([(f"k{i}", 1, 2) for i in range(100)] + [(None, 1, 0), ("z", 0, 0)]), "a")
    assert not store.apply(df([("k0", 1, 2)]), "a")
    for i in range(8):
        assert store.apply(df([("k1", 1, 0), (f"n{i}", 1, 1)]), f"d{i}")
    assert store.layers() <= 4
    assert store.apply(df([(f"k{i}", -1, -2) for i in range(2, 100)]), "b")
    got = {r.k: (r.n, r.m) for r in store.read().collect()}
    assert got == {"k0": (1, 2), "k1": (9, 2), None: (1, 0), **{f"n{i}": (1, 1) for i in range(8)}}
    import os

    assert len([x for x in os.listdir(tmp_path / "s") if x.startswith("manifest-")]) == 2
    assert len([x for x in os.listdir(tmp_path / "s") if x.startswith("layer-")]) <= 6
