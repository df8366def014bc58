import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from utterlake.llm.leakage import distance_at, extensions, leaked_items, leaks

DOCS, ITEMS = "doc_id bigint, text string, item_id int", "item_id int, text string, task string, doc_id int"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@given(st.text("abc", max_size=14), st.text("abc", max_size=12), st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_bit_vectors_give_the_edit_distance(pattern, text, k):
    best = extensions(pattern, text, k)
    want = [min(edit(pattern[:i], text[:a]) for i in range(len(pattern) + 1)) for a in range(len(text) + 1)]
    assert best == want[: len(best)] and all(w > k for w in want[len(best) : len(best) + 1])


def test_window_around_a_piece():
    item = "abcdefghijklmnopqrst"
    assert distance_at("xx" + item + "yy", 2 + 8, item, 8, 4, 20, 2) == 0
    assert distance_at("xx" + item.replace("c", "").replace("q", "Q") + "yy", 2 + 7, item, 8, 4, 20, 2) == 2
    assert distance_at("xx" + item.replace("c", "").replace("q", "Q") + "yy", 2 + 7, item, 8, 4, 20, 1) is None


def letters(s):
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFC", s).lower())


def test_against_brute_force(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("가나다라마바사 .") for _ in range(n))
    items = [(i, text(rnd.choice([20, 45, 90])), "t", 0) for i in range(25)]
    docs = []
    for d in range(60):
        t = text(120)
        if d % 2:
            src = rnd.choice(items)[1]
            a = rnd.randrange(len(src))
            piece = src[a : a + rnd.randrange(30, 80)] if d % 4 == 1 else src
            if d % 3 == 0 and len(piece) > 10:
                piece = piece[:7] + "하" + piece[8:]
            t = t[:50] + unicodedata.normalize(rnd.choice(["NFC", "NFD"]), piece) + t[50:]
        docs.append((d, t, 1))
    got = {(r.doc_id, r.item_id): r.distance for r in leaks(spark.createDataFrame(docs + docs[:5], DOCS), spark.createDataFrame(items + items[:3], ITEMS)).collect()}
    near = {}
    for d, t, _ in docs:
        t = letters(t)
        for i, s, _, _ in items:
            s = letters(s)
            w = min(40, len(s))
            k = min(2, w // 10)
            best = 9
            for a in range(len(s) - w + 1):
                p, row = s[a : a + w], [0] * (len(t) + 1)
                for x_, x in enumerate(p, 1):
                    prev, row[0] = row[0], x_
                    for j, y in enumerate(t, 1):
                        prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
                best = min(best, *row)
            if best <= k:
                near[(d, i)] = best
    assert got == near and 0 in near.values() and any(near.values())


def test_nulls_empty_and_short(spark):
    items = spark.createDataFrame([(1, None, "t", 0), (None, "abc", "t", 0), (2, " .,", "t", 0), (3, "A-b", "t", 0)], ITEMS)
    docs = spark.createDataFrame([(1, "xaBx", 0), (2, None, 0), (None, "ab", 0), (3, "", 0), (4, "ab" + "z" * 400_000, 0)], DOCS)
    hits = leaks(docs, items)
    assert sorted(map(tuple, hits.collect())) == [(1, 3, 0), (4, 3, 0)]
    assert [tuple(r) for r in leaked_items(hits, items).collect()] == [(3, "t", 2, 0)]
    assert leaks(docs.limit(0), items).count() == leaks(docs, items.limit(0)).count() == 0
