import random

from utterlake.llm.turns import completed_turns

SM = "utt_id string, session_id string, speaker_id string, start string, form string, original_form string"
A, B = "SD200000001", "SD200000002"
WORDS = {A: ["바다", "배", "섬", "파도", "물"], B: ["산", "나무", "숲", "바위", "길"]}


def completed(spark, rows, meta, **kw):
    dj = spark.createDataFrame([], "utt_id string, original_form string")
    return completed_turns(spark.createDataFrame(rows, SM), dj, spark.createDataFrame(meta, "file_id string, speaker_ids string"), **kw).orderBy("session_id", "turn_no").collect()


def test_speaker_changes_inside_an_unlabelled_run(spark):
    """Two people alternate without labels: each change is a turn, and runs join the labelled turns beside them."""
    rnd, s, rows, truth = random.Random(3), "SDRW2000000001", [], []
    for i in range(1, 81):
        who = (A, B)[(i - 1) // 2 % 2]
        text = " ".join(rnd.choice(WORDS[who]) for _ in range(8))
        rows.append((f"{s}.1.1.{i}", s, None if 31 <= i <= 60 else who, str(i), text, text))
        truth.append((i, who, text))
    got = completed(spark, rows, [(s, f"{A}|{B}")], with_text=True)
    assert [(r.turn_no, r.likely_speaker, r.first_utt_id, r.last_utt_id, r.n_utterances, r.start) for r in got] == [(k + 1, (A, B)[k % 2], f"{s}.1.1.{2 * k + 1}", f"{s}.1.1.{2 * k + 2}", 2, 2.0 * k + 1) for k in range(40)]
    assert [r.speaker_id for r in got] == ["" if 15 <= k < 30 else (A, B)[k % 2] for k in range(40)]
    assert [r.text for r in got] == [f"{truth[2 * k][2]} {truth[2 * k + 1][2]}" for k in range(40)]
