from utterlake.llm.turns import completed_turns

SM = "utt_id string, session_id string, speaker_id string, start string, form string, original_form string"
A, B, C = "SD200000001", "SD200000002", "SD200000003"


def test_speakers_heard_but_not_listed_can_be_chosen(spark):
    """One session without file_meta, one whose list is empty, one whose list lacks a speaker, one with no speaker at all."""
    words, rows = {A: "바다 배 섬", B: "산 숲 길", C: "밥 국 물"}, []
    for s, heard in (("S1", [A, B]), ("S2", [A, B]), ("S3", [A, C])):
        for i in range(1, 41):
            who = heard[i // 5 % 2]
            rows.append((f"{s}.1.1.{i}", s, None if i in (17, 18) else who, str(i), words[who], words[who]))
    rows.append(("S4.1.1.1", "S4", None, "1", "바다", "바다"))
    dj = spark.createDataFrame([], "utt_id string, original_form string")
    meta = spark.createDataFrame([("S2", ""), ("S3", f"{A}|{B}")], "file_id string, speaker_ids string")
    got = completed_turns(spark.createDataFrame(rows, SM), dj, meta).collect()
    at = {r.first_utt_id: r for r in got}
    for s, who in (("S1", B), ("S2", B), ("S3", C)):
        assert (at[f"{s}.1.1.15"].likely_speaker, at[f"{s}.1.1.15"].n_utterances) == (who, 5)
    assert at["S4.1.1.1"].likely_speaker == ""
