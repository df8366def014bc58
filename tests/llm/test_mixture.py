import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterlake.llm.mixture import TOKENIZERS, Mixture, sainte_lague

DOCS, TARGETS = "doc_id bigint, source string, text string, tokens int, shard int, copies int", "source string, target_share double, max_repeats int"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no vocabulary files")


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 40)), min_size=1, max_size=6), st.integers(0, 120))
@settings(max_examples=300, deadline=None)
def test_highest_quotients(parties, seats):
    w, caps = [float(p[0]) for p in parties], [p[1] for p in parties]
    own = [0] * len(w)
    for _ in range(seats):
        open_ = [i for i in range(len(w)) if own[i] < caps[i] and w[i] > 0]
        if not open_:
            break
        own[max(open_, key=lambda i: (w[i] / (2 * own[i] + 1), -i))] += 1
    assert sainte_lague(w, seats, caps) == own


def documents(spark):
    rows = [(i, "big", "word " * 50, 1, 1, 1) for i in range(300)] + [(1000 + i, "small", "word " * 50, 1, 1, 1) for i in range(30)] + [(2000, None, "word " * 500, 1, 1, 1), (2001, "small", None, 1, 1, 1), (2002, "other", "", 1, 1, 1), (None, "big", "x", 1, 1, 1)]
    return spark.createDataFrame(rows, DOCS)


@needs_vocabulary
def test_shares_repeats_and_seed(spark):
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 4), ("none", 0.1, 5), (None, 0.1, 1)], TARGETS)
    m = Mixture(documents(spark), targets, block_tokens=100, shard_tokens=4000)
    picked = [tuple(r) for r in m.selection().collect()]
    by = lambda s: [p for p in picked if p[1] == s]
    assert {p[3] for p in by("big")} == {1} and {p[3] for p in by("small")} <= {3, 4}
    total = sum(p[2] * p[3] for p in picked)
    assert sum(p[2] for p in by("big")) / total == pytest.approx(0.7, abs=0.04)
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["small"].share == pytest.approx(1 - shares["big"].share) and shares["none"].share == 0 and shares["none"].unreachable
    assert [r.source for r in m.unreachable().collect()] == ["none"]
    again = Mixture(documents(spark).repartition(7), targets, block_tokens=100, shard_tokens=4000)
    assert sorted(map(tuple, again.selection().collect())) == sorted(picked)
    other = Mixture(documents(spark), targets, block_tokens=100, shard_tokens=4000, seed=18)
    assert sorted(map(tuple, other.selection().collect())) != sorted(picked)


@needs_vocabulary
def test_cap_is_never_passed(spark):
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], TARGETS)
    m = Mixture(documents(spark), targets, block_tokens=64, shard_tokens=1000)
    assert max(r.copies for r in m.selection().where("source = 'small'").collect()) == 2
    assert max(r.copies for r in m.selection().where("source = 'big'").collect()) == 1
    assert [r.source for r in m.unreachable().collect()] == ["small"]


@needs_vocabulary
def test_empty(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", None, None)], TARGETS)
    m = Mixture(documents(spark).limit(0), targets)
    assert m.selection().count() == 0 and m.shares().count() == 2
    none = Mixture(documents(spark), targets.limit(0))
    assert none.selection().count() == 0 and none.unreachable().count() == 0


@needs_vocabulary
def test_what_is_out_of_reach_is_used_up(spark):
    """A source below one block, and one that can't reach its share, give all they have as often as they may."""
    docs = spark.createDataFrame([(i, "big", "word " * 50) for i in range(200)] + [(900, "tiny", "word " * 20), (901, "few", "word " * 130), (902, "few", "word " * 130)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("tiny", 0.3, 3), ("few", 0.3, 2)], TARGETS)
    m = Mixture(docs, targets, block_tokens=100)
    got = {r.doc_id: r.copies for r in m.selection().collect()}
    assert got[900] == 3 and got[901] == got[902] == 2 and max(c for d, c in got.items() if d < 900) == 1
    assert sorted(r.source for r in m.unreachable().collect()) == ["few", "tiny"]
