import random

from utterlake.llm.terms import RECORDS, TermCounts, count_terms, marked, record_changes, term_deltas, utterance_records
from utterlake.session import new_path

SCHEMA = "utt_id string, form string, tagged string"


def counts(df):
    return {(r.field, r.term): (r.occurrences, r.records) for r in df.collect()}


def test_terms_of_a_record(spark):
    d = spark.createDataFrame([("u", "\"가자, ​가자!\" … 가자 Ab", "가/VV+자/EF ./SF"), ("v", None, None), ("w", "", " ")], SCHEMA)
    assert counts(term_deltas(d)) == {
        (RECORDS, ""): (3, 3), ("form", "가자"): (3, 1), ("form", "Ab"): (1, 1), ("tagged", "가/VV"): (1, 1), ("tagged", "자/EF"): (1, 1), ("tagged", "./SF"): (1, 1)
    }


def test_composed_case_kept_inner_symbols_kept(spark):
    d = spark.createDataFrame([("u", "가 가 A a-b", None)], SCHEMA)
    assert counts(term_deltas(d).where("field = 'form'")) == {("form", "가"): (2, 1), ("form", "A"): (1, 1), ("form", "a-b"): (1, 1)}


def test_deltas_lead_to_the_full_count(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("가나다라마바사") + rnd.choice(["", "은", "는"])
    row = lambda i: (f"u{i}", " ".join(word() for _ in range(rnd.randrange(6))), "+".join(word() + "/NN" for _ in range(rnd.randrange(1, 4))))
    first = [row(i) for i in range(60)]
    second = [row(i) if i % 7 == 0 else first[i] for i in range(40)] + [row(i) for i in range(60, 75)]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (first, second))
    store = TermCounts(spark, new_path(spark, "terms"))
    store.apply(term_deltas(a))
    changes = record_changes(a, b)
    assert changes.count() < 60
    store.apply(term_deltas(changes))
    assert counts(store.read()) == counts(term_deltas(b))
    again = TermCounts(spark, store.path)
    again.apply(term_deltas(record_changes(b, b)))
    assert counts(again.read()) == counts(term_deltas(b))
    again.apply(term_deltas(record_changes(b, b.limit(0))))
    assert counts(again.read()) == {}


def test_marks_copies_and_clashing_columns(spark):
    rows = [(f"u{i}", "흔한" + (" 드문" if i == 0 else "") + (" 둘" if i < 2 else ""), None, "x", 1) for i in range(100)]
    d = spark.createDataFrame(rows + rows + [(None, "없음", None, "x", 1)], SCHEMA + ", field string, _words int")
    got = {r.term: r.mark for r in marked(count_terms(d, new_path(spark, "terms"))).collect()}
    assert got == {"흔한": "common", "드문": "rare", "둘": None}
    assert counts(term_deltas(utterance_records(d)))[(RECORDS, "")] == (100, 100)


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert marked(count_terms(empty, new_path(spark, "terms"))).count() == 0
    long = spark.createDataFrame([("u", "가 나 " * 100_000, None)], SCHEMA)
    assert counts(term_deltas(long))[("form", "나")] == (100_000, 1)


def test_loads_in_steps_give_one_pass(spark):
    """Late rows, copies and changed records, taken in by load time, give the counts of the whole table; a repeated step is harmless."""
    import datetime as dt

    day = lambda d: dt.datetime(2026, 1, d)
    rows = [("a", "하나 둘", None, day(1)), ("b", "둘", "둘/NR", day(2)), ("b", "둘", "둘/NR", day(4)), ("c", "셋", None, day(4)), ("d", "하나", None, None), ("e", "가", None, day(2)), ("e", "나", None, day(5)), ("e", "나", None, day(6)), (None, "x", None, day(4))]
    d = spark.createDataFrame(rows, SCHEMA + ", loaded_at timestamp_ntz")
    want = counts(term_deltas(utterance_records(d)))
    path = new_path(spark, "terms")
    assert counts(count_terms(d, path, [day(2), day(4), day(5), None])) == want
    assert counts(count_terms(d, path, [day(2), day(4), day(5), None])) == want
    assert counts(count_terms(d, new_path(spark, "terms"))) == want
    assert want[("form", "나")] == (1, 1) and ("form", "가") not in want
