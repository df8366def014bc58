"""The boundary table against a plain rule-by-rule reading of the sound changes, and worked examples."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterlake.functions.hangul import CODAS, ONSETS, RULES, boundary, boundary_table, compose_codes, ipa_map, syllable_codes, to_ipa, with_pronunciation
from pyspark.sql import functions as F

EXAMPLES = """저는 여행 다니는 것을→저는 여행 다니는 거슬; 국물→궁물; 신라→실라; 칼날→칼랄; 담력→담력; 강릉→강릉; 좋아하는데요→조아하는데요; 많이→마니; 싫어→시러; 굳이→구지; 같이→가치;
국밥→국빱; 학교→학꾜; 밝다→박따; 값→갑; 닭→닥; 읽어→일거; 좋다→조타; 축하→추카; 꽃→꼳; 앞→압; 신고[신/VV+고/EC]→신꼬; 안고[안/VV+고/EC]→안꼬; 감고[감/VV+고/EC]→감꼬;
앉다[앉/VV+다/EC]→안따; 넓게[넓/VA+게/EC]→널께; 알고[알/VV+고/EC]→알고"""
ROMAN = {"것을": "G EO _ S EU l", "국물": "G U ng _ M U l", "밝다": "B A k _ TT A"}


def plain(word, gaps=()):
    """Syllable triples through one rule after the other."""
    s = [[ONSETS[c // 588], c % 588 // 28, CODAS[c % 28].strip()] for c in (ord(x) - 44032 for x in word)]
    pairs = list(zip(s, s[1:], strict=False))
    neutral = {**dict.fromkeys("ㅋㄲ", "ㄱ"), **dict.fromkeys("ㅅㅆㅈㅊㅌㅎ", "ㄷ"), "ㅍ": "ㅂ"}
    drop = {"ㅎ": "", "ㄶ": "ㄴ", "ㅀ": "ㄹ"}
    for a, b in pairs:
        if a[2] in drop and b[0] in "ㄱㄷㅈㅅ":
            b[0], a[2] = dict(zip("ㄱㄷㅈㅅ", "ㅋㅌㅊㅆ", strict=True))[b[0]], drop[a[2]]
        elif b[0] == "ㅎ" and (n := neutral.get(a[2], a[2])) and n in "ㄱㄷㅂ":
            b[0], a[2] = dict(zip("ㄱㄷㅂ", "ㅋㅌㅍ", strict=True))[n], ""
    for a, b in pairs:
        if b[0] == "ㅇ" and a[2] in drop:
            a[2] = drop[a[2]]
    for a, b in pairs:
        if a[2] in ("ㄷ", "ㅌ") and b[1] == 20 and b[0] in "ㅇㅎ":
            b[0], a[2] = "ㅈ" if a[2] == "ㄷ" and b[0] == "ㅇ" else "ㅊ", ""
    link = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅄ": "ㅂㅅ"}
    for a, b in pairs:
        if b[0] == "ㅇ" and a[2] not in ("", "ㅇ"):
            a[2], b[0] = tuple(link[a[2]]) if a[2] in link else ("", a[2])
    one = dict(zip("ㄳㄵㄶㄺㄻㄼㄽㄾㄿㅀㅄ", "ㄱㄴㄴㄱㅁㄹㄹㄹㅂㄹㅂ", strict=True))
    for x in s:
        x[2] = neutral.get(x[2], x[2])
        x[2] = one.get(x[2], x[2])
    for a, b in pairs:
        if a[2] + b[0] == "ㄴㄹ":
            a[2] = "ㄹ"
        elif a[2] + b[0] == "ㄹㄴ":
            b[0] = "ㄹ"
        elif a[2] in ("ㄱ", "ㄷ", "ㅂ") and b[0] in "ㄴㅁ":
            a[2] = dict(zip("ㄱㄷㅂ", "ㅇㄴㅁ", strict=True))[a[2]]
    tense = dict(zip("ㄱㄷㅂㅅㅈ", "ㄲㄸㅃㅆㅉ", strict=True))
    for i, (a, b) in enumerate(pairs):
        if b[0] in tense and (a[2] in ("ㄱ", "ㄷ", "ㅂ") or (i in gaps and b[0] != "ㅂ")):
            b[0] = tense[b[0]]
    codas = [c.strip() for c in CODAS]
    return "".join(chr(44032 + ONSETS.index(o) * 588 + v * 28 + codas.index(c)) for o, v, c in s)


def through_table(word, gaps=()):
    table, last = boundary_table()
    s = [ord(x) - 44032 for x in word]
    at = [table[((a % 28 * 19 + b // 588) * 2 + (b % 588 // 28 == 20)) * 2 + (i in gaps)] for i, (a, b) in enumerate(zip(s, s[1:], strict=False))]
    return "".join(chr(44032 + (c // 588 if i == 0 else at[i - 1] % 19) * 588 + c % 588 // 28 * 28 + (last[c % 28] if i == len(s) - 1 else at[i] // 19)) for i, c in enumerate(s))


@given(st.text(st.characters(min_codepoint=44032, max_codepoint=55203), min_size=1, max_size=6), st.sets(st.integers(0, 4)))
@settings(max_examples=2000, deadline=None)
def test_table_is_the_rules(word, gaps):
    assert through_table(word, gaps) == plain(word, gaps)


def test_all_boundaries_and_codas():
    spoken = {"", *"ㄱㄴㄷㄹㅁㅂㅇ"}
    on = frozenset(RULES)
    assert all(boundary(c.strip(), o, i, g, on)[0] in spoken for c in CODAS for o in ONSETS for i in (False, True) for g in (False, True))
    for off in RULES:  # no rule is needed by another
        boundary_table(frozenset(RULES) - {off})


def rows(text):
    for x in text.replace("\n", " ").split(";"):
        a, b = x.strip().split("→")
        form, _, tagged = a.rstrip("]").partition("[")
        yield form, tagged or None, b


def test_examples(spark):
    want = list(rows(EXAMPLES))
    got = with_pronunciation(spark.createDataFrame(want, "form string, tagged string, want string")).collect()
    assert [(r.form, r.pron_pred_hangul) for r in got] == [(r.form, r.want) for r in got]
    r = {x.form: x.pron_pred_roman for x in with_pronunciation(spark.createDataFrame([(k, None) for k in ROMAN], "form string, tagged string")).collect()}
    assert r == ROMAN


def test_whole_words_in_spark(spark):
    rnd = random.Random(5)
    words = ["".join(chr(rnd.randrange(44032, 55204)) for _ in range(rnd.randrange(1, 7))) for _ in range(400)]
    got = with_pronunciation(spark.createDataFrame([(w,) for w in words], "form string"), tagged=None).select("form", "pron_pred_hangul", "pron_pred_roman", "pron_pred_ipa").collect()
    assert all(r.pron_pred_hangul == plain(r.form) for r in got)
    back = spark.createDataFrame([(w,) for w in words], "w string").select("w", compose_codes(syllable_codes(F.col("w"))).alias("b")).collect()
    assert all(r.w == r.b for r in back)
    ipa = spark.createDataFrame([(r.pron_pred_roman, r.pron_pred_ipa) for r in got], "r string, i string").select("i", to_ipa(F.col("r"), ipa_map()).alias("t")).collect()
    assert all(r.i == r.t for r in ipa)


def test_other_words_and_warnings(spark):
    df = spark.createDataFrame([("12개 abc 값,", "12/SN"), ("", None), (None, None), ("가ㅋ 나", "가/VV 나/NP")], "form string, tagged string")
    got = with_pronunciation(df).collect()
    assert [r.pron_pred_hangul for r in got] == ["∅ ∅ 갑", "", "", "∅ 나"]
    assert [r.align_warn for r in got] == ["eojeol_tag_mismatch(3!=1)", "", "", ""]
    assert [r.n_eojeol for r in got] == [3, 0, 0, 2]


@pytest.mark.parametrize(("x", "y"), [("G foo", "k⟨foo⟩"), ("∅", "∅")])
def test_unknown_sounds_show(spark, x, y):
    assert spark.createDataFrame([(x,)], "r string").select(to_ipa(F.col("r"), ipa_map())).first()[0] == y


def test_memory_says_what_columns_say(spark):
    """The Arrow function with a memory of words gives what the column expressions give."""
    from utterlake.functions.hangul import with_pronunciation_columns

    rows = [("저는 여행 다니는 것을", None), ("신고 안고 앉다 넓게!", "신/VV+고/EC 안/VV+고/EC 앉/VV+다/EC 넓/VA+게/EC+!/SF"), ("신고", "신/VV+고/EC 더/MAG"), ("ab 값 12 닭이", "ab/SL|값/NNG|12/SN|닭/NNG+이/JKS"), (None, None), ("  ", "x/NNG"), ("감고 감고", "감/VV+고/EC 감/NNG+고/JC")]
    df = spark.createDataFrame(rows, "form string, tagged string")
    cols = ["form", "tagged", "n_eojeol", "form_roman", "pron_pred_hangul", "pron_pred_roman", "pron_pred_ipa", "align_warn"]
    for on in (RULES, tuple(r for r in RULES if r not in ("liaison", "stem_fortis"))):
        a, b = (sorted(map(str, f(df, rules=on).select(*cols).collect())) for f in (with_pronunciation, with_pronunciation_columns))
        assert a == b
