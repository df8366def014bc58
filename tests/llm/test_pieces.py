import itertools
import random

import numpy as np
import pytest

from utterlake.llm import turns
from utterlake.llm.turns import best_scores, piece_ends, viterbi

SM = "utt_id string, session_id string, speaker_id string, start string, form string, original_form string"


def test_pieces_give_the_path_of_the_whole():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, k, stay = int(rng.integers(2, 30)), int(rng.integers(1, 5)), 0.8
        e, before, after = rng.normal(size=(n, k)), int(rng.integers(-1, k)), int(rng.integers(-1, k))
        cuts = sorted({0, n, *rng.integers(1, n, size=4).tolist()})
        pieces = [e[a:b] for a, b in itertools.pairwise(cuts)]
        ends = piece_ends([best_scores(x, stay) for x in pieces], before, after, stay)
        path = [viterbi(x, before if i == 0 else -1, after if i == len(pieces) - 1 else -1, stay, *ends[i]) for i, x in enumerate(pieces)]
        assert np.concatenate(path).tolist() == viterbi(e, before, after, stay).tolist()


@pytest.mark.parametrize("step", [1, 400])
def test_label_beyond_a_cut_is_heard(spark, monkeypatch, step):
    """Without words of their own, utterances between two labels of one speaker are that speaker's, whatever lies between the pieces."""
    monkeypatch.setattr(turns, "PIECE", 2)
    rnd, s, a, b = random.Random(5), "SDRW2000000001", "SD200000001", "SD200000002"
    rows = []
    for i in range(1, 31):
        who = b if i > 5 else a
        text = " ".join(rnd.choice(["네", "응"]) for _ in range(2)) if 10 < i < 20 else {a: "바다 배", b: "산 숲"}[who]
        rows.append((f"{s}.1.1.{i}", s, None if 10 < i < 20 else who, str(i * step), text, text))
    dj = spark.createDataFrame([], "utt_id string, original_form string")
    got = turns.completed_turns(spark.createDataFrame(rows, SM), dj, spark.createDataFrame([(s, f"{a}|{b}")], "file_id string, speaker_ids string")).orderBy("turn_no").collect()
    assert [(r.likely_speaker, r.n_utterances) for r in got] == [(a, 5), (b, 25)]
