import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm.turns import clean_text, has_content, speaker_turns, viterbi

SM = "utt_id string, session_id string, speaker_id string, start string, form string, original_form string, turn int, at string, label string"
DJ = "utt_id string, original_form string, note string, text string"
FM = "file_id string, speaker_ids string, people string"


def run(spark, sm, dj, fm, **kw):
    pad = [(*r, *[None] * (9 - len(r))) for r in sm]
    return speaker_turns(spark.createDataFrame(pad, SM), spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in dj], DJ), spark.createDataFrame([(*r, "x") for r in fm], FM), **kw)


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<00:00:35.347> 추억에 남겼어요.", "추억에 남겼어요."), ("00:52 동생의 갔어요", "동생의 갔어요"), ("[00:00:31] (00:43) {기침} ((잡음)) （침묵） *문 닫는 소리* <웃음>", ""), ("음... 어어~ 그- 흐음. Uh 엄- 어…", ""), ("음 네.", "네."),
        ("&name1& 왔네", "&name1& 왔네"), ("가- 가방이 배웠는데요", "가방이 배웠는데요"), ("응", "응"), ("예?", "예?"), (None, ""), ("", ""), ("그 사람 그", "사람"), ("12:30:11.2 31+0", "31+0"), ("아이가 어제 그림을", "아이가 어제 그림을"),
    ],
)
def test_clean(spark, text, clean):
    r = spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t")).alias("c")).select("c", has_content(F.col("c")).alias("h")).first()
    assert (r.c, r.h) == (clean, clean != "")


def test_order_carry_and_merge(spark):
    s = "SDRW2000000001"
    u = lambda n, sp, start, text="말": (f"{s}.1.1.{n}", s, sp, start, text, text)
    sm = [u(1, "SD200000001", "1.0"), u(1, "SD200000001", "1.0"), u(2, "1", None), u(10, "P2", "00:00:03"), u(3, "화자 2", "2,5"), u(4, "SD200000002", "9s", "음"), u(5, None, "10000ms"), u(6, "", "NA"), u(7, "P1", "11"), (None, s, "x", "1", "a", "a"), ("z.1", None, "x", "1", "a", "a")]
    dj = [(f"{s}.1.1.7", "어… <웃음>"), (f"{s}.1.1.5", None), ("other.1", "말")]
    got = [tuple(r) for r in run(spark, sm, dj, [(s, "SD200000001|SD200000002")]).select("session_id", "turn_no", "speaker_id", "first_utt_id", "last_utt_id", "n_utterances").orderBy("turn_no").collect()]
    assert got == [(s, 1, "SD200000001", f"{s}.1.1.1", f"{s}.1.1.2", 2), (s, 2, "SD200000002", f"{s}.1.1.3", f"{s}.1.1.10", 2), (s, 3, "", f"{s}.1.1.5", f"{s}.1.1.6", 2)]


def test_long_session_over_many_blocks(spark):
    """Turns that cross blocks of numbers and of time are those of one sorted list."""
    rnd, s, n = random.Random(1), "SDRW2000000002", 3000
    rows, t = [], 0.0
    for i in range(1, n + 1):
        t += rnd.choice([0, 0.5, 1, 700])
        rows.append((i, t if rnd.random() > 0.2 else None, rnd.choice("AAB")))
    sm = [(f"{s}.1.1.{i}", s, f"SD20000000{x}", None if b is None else str(b), "말", "말") for i, b, x in rows]
    last, order = -1.0, []
    for i, b, x in rows:
        last = last if b is None else b
        order.append((last, i, x))
    order.sort()
    want = []
    for _, i, x in order:
        if want and want[-1][0] == f"SD20000000{x}":
            want[-1][2] = i
        else:
            want.append([f"SD20000000{x}", i, i])
    got = run(spark, sm, [], []).orderBy("turn_no").collect()
    assert [r.turn_no for r in got] == list(range(1, len(want) + 1))
    assert [(r.speaker_id, r.first_utt_id, r.last_utt_id) for r in got] == [(a, f"{s}.1.1.{b}", f"{s}.1.1.{c}") for a, b, c in want]


def test_inferred_speakers(spark):
    """Labels taken away at random come back from the words, far more often than by the larger share."""
    rnd = random.Random(7)
    words = {"SD200000001": ["바다", "배", "섬", "파도", "물"], "SD200000002": ["산", "나무", "숲", "바위", "길"]}
    sm, truth = [], {}
    for k in range(6):
        s = f"SDRW20000001{k:02d}"
        who = "SD200000001"
        for i in range(1, 61):
            if rnd.random() < 0.4:
                who = rnd.choice(list(words))
            text = " ".join(rnd.choice(words[who] + ["그리고", "했어요"]) for _ in range(5))
            hidden = rnd.random() < 0.25
            sm.append((f"{s}.1.1.{i}", s, None if hidden else who, str(i), text, text))
            if hidden:
                truth[f"{s}.1.1.{i}"] = who
    got = run(spark, sm, [], [(f"SDRW20000001{k:02d}", "SD200000001|SD200000002") for k in range(6)], with_text=True).collect()
    single = [r for r in got if r.speaker_id == "" and r.n_utterances == 1]
    right = sum(truth[r.first_utt_id] == r.likely_speaker for r in single)
    assert len(single) > 30 and right / len(single) > 0.9
    assert all(r.likely_speaker == r.speaker_id for r in got if r.speaker_id)
    assert all(r.text for r in got)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(40):
        n, k, stay = 4, 3, 0.6
        e, before, after = rng.normal(size=(n, k)), int(rng.integers(-1, k)), int(rng.integers(-1, k))
        move = lambda a, b: 0.0 if a < 0 or b < 0 else np.log(stay if a == b else (1 - stay) / (k - 1))  # noqa: E731, B023
        value = lambda p: sum(e[t, x] for t, x in enumerate(p)) + sum(move(a, b) for a, b in zip([before, *p], [*p, after], strict=True))  # noqa: E731, B023
        best = max(itertools.product(range(k), repeat=n), key=value)
        assert value(tuple(viterbi(e, before, after, stay))) == pytest.approx(value(best))


def test_empty(spark):
    assert run(spark, [], [], []).count() == 0
    assert run(spark, [], [], [], with_text=True).count() == 0
