import pytest

from utterlake.functions.text import packed_roman, packed_tagged
from utterlake.operators.packed import unpack_values

TAGGED = [
    ("나/NP+는/JX 가/VV", [["나/NP", "는/JX"], ["가/VV"]]),
    ("나/NP + 는/JX | 가/VV", [["나/NP", "는/JX"], ["가/VV"]]),
    ("나/NP+는/JX|가/VV|", [["나/NP", "는/JX"], ["가/VV"]]),
    ("나/NP;는/JX  가/VV;./SF ", [["나/NP", "는/JX"], ["가/VV", "./SF"]]),
    ("나/NP＋는/JX\t가/VV", [["나/NP", "는/JX"], ["가/VV"]]),
    ("나/NP+는/JX 가/VV　오/VV", [["나/NP", "는/JX"], ["가/VV"], ["오/VV"]]),
    ('["나/NP+는/JX", "가/VV+./SF"]', [["나/NP", "는/JX"], ["가/VV", "./SF"]]),
    ("'나/NP+는/JX','가/VV'", [["나/NP", "는/JX"], ["가/VV"]]),
    ('"나/NP 가/VV+"".""/SF"', [["나/NP"], ["가/VV", "./SF"]]),
    ('"5/SN+""+""/SW+3/SN 네/IC"', [["5/SN", "+/SW", "3/SN"], ["네/IC"]]),
    ("5/SN++/SW+3/SN", [["5/SN", "+/SW", "3/SN"]]),
    ("5/SN + +/SW + 3/SN | 네/IC", [["5/SN", "+/SW", "3/SN"], ["네/IC"]]),
    ("7/SN+//SP+3/SN", [["7/SN", "//SP", "3/SN"]]),
    ('네/IC+"/SS+네/IC+"/SS', [["네/IC", '"/SS', "네/IC", '"/SS']]),
    ('"네/IC"', [["네/IC"]]),
    ("", []),
    ("  ", []),
    (None, None),
]
ROMAN = [
    ("G A _ S EO | YE", [["G A", "S EO"], ["YE"]]),
    ("G A_S EO|∅|YE", [["G A", "S EO"], ["∅"], ["YE"]]),
    ("G A - S EO | _ | YE", [["G A", "S EO"], ["∅"], ["YE"]]),
    ("| G A _ S EO || YE |", [["G A", "S EO"], ["YE"]]),
    ("G A . S EO / YE", [["G A", "S EO"], ["YE"]]),
    ("G A  _ S EO\tYE", [["G A", "S EO"], ["YE"]]),
    ("G\xa0A - S\xa0EO ; YE", [["G A", "S EO"], ["YE"]]),
    ('"G A _ S EO","∅","YE"', [["G A", "S EO"], ["∅"], ["YE"]]),
    ('"G A _ S EO | YE"', [["G A", "S EO"], ["YE"]]),
    ("", []),
    (None, None),
]


@pytest.mark.parametrize(("split", "cases"), [(packed_tagged, TAGGED), (packed_roman, ROMAN)])
def test_conventions(spark, split, cases):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = {r.i: r.words for r in split(df, "x").collect()}
    assert [got[i] or None for i in range(len(cases))] == [w or None for _, w in cases]


def test_positions_copies_nulls_and_clashing_columns(spark):
    b = spark.createDataFrame(
        [("u1", "가/VV+고/EC  오/VV", "x", 1), ("u1", "가/VV+고/EC  오/VV", "y", 2), ("u2", None, "z", 3), (None, "가/VV", "z", 4), ("u3", "", "z", 5)], "utt_id string, tagged string, words string, word_idx int"
    )
    s = spark.createDataFrame([("u1", "G A | ∅", 1)], "utt_id string, pron_pred_roman string, _s int")
    rows = sorted(tuple(r) for r in unpack_values(b, s).collect())
    assert rows == [("pron_pred_roman", "u1", 1, 1, "G A"), ("pron_pred_roman", "u1", 2, 1, "∅"), ("tagged", "u1", 1, 1, "가/VV"), ("tagged", "u1", 1, 2, "고/EC"), ("tagged", "u1", 2, 1, "오/VV")]
    assert unpack_values(b.limit(0), s.limit(0)).count() == 0


def test_long_field(spark):
    long = " ".join(["가/VV+고/EC"] * 60_000)
    quoted = '["' + '", "'.join(["가/VV"] * 60_000) + '"]'
    df = spark.createDataFrame([("a", long), ("b", quoted)], "utt_id string, tagged string")
    none = spark.createDataFrame([], "utt_id string, pron_pred_roman string")
    assert {r.utt_id: r["count"] for r in unpack_values(df, none).groupBy("utt_id").count().collect()} == {"a": 120_000, "b": 60_000}
