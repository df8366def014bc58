import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterlake.llm.quality import LINES, Lexicon, Text, prepared, quality, whole_sums

LEX = Lexicon(frozenset({"the", "정말"}))
PROSE = {
    "wrapped": "가게는 매우 화면이 진짜 산하고 특히\n춤은 압니다. 보통 담선은 국분 법에 그냥\n정말 숲을 씻습니다.",
    "one word a line": "생각은\n혼자\n나중에\n밥을\n먹었습니다.\n그리고",
    "quoted": "> 사람을 선택합니다. 먼저 시계가 잤다가\n> 음식은 좋았습니다.",
    "unpunctuated": "고쳤는데 기건을 고기 오고 고반을 습관은 사진으로 갑니다\n생각보다 이야기를 부모님을 뛰었다",
    "labelled": "가: 아이가 먹지만 학교는 눈을 아팠네.\n나: 네.\n화자 1: 음식은 여행했는데 벗네요?",
    "english": "On garden at kitchen the sentence marks the consonant.\nThe word is in the house of a friend",
    "list at the end": "신문은 별이 모자도 습관을 먹었지.\n식당은 특히 저녁이 반등에 듣습니다.\n- 내일\n- 차",
    "heading": "가족 남설\n모음이 진짜 농사도 만나든지 조금 씻습니다.",
}
JUNK = {
    "blank": " \n​\t", "none": None, "bullets": "- 가변\n- 내일\n- 속공 시본\n사람이 집에 갔습니다.", "gloss": "가류: 변무\n등속: 강강\n간수: 소배", "numbered": "1. 문제 리목\n2) 산공 겨울\n(3) 술사, 명각 및 로과.\n가) 도실(감부)",
    "tabs": "교고\tNNG\t466\t0.855\n단담\tNNG\t5\t0.1", "columns": "력선           390     20.36\n무국           621     82.42", "csv": "utt_id,form,n\nS.1.1.0,가상,15", "pipes": "| 형태 | 빈도 |\n|---|---|\n| 그림 | 825 |",
    "log": "[08:00:48] session 1706 rows=293 warn=0", "textgrid": 'xmin = 0.000\nxmax = 0.300\ntext = "강"', "tagged": "내강/NNG+는/JX 문기/NNP+을/JKO 거단/NNG", "nouns": "각강 경문 담수 군개 리산 세구 강상 내력 복목 그림 정책 농복",
    "noun lines": "경상\n학교\n담속\n국물", "commas": "감보, 소신, 본신, 과거\n국각, 거단, 반문", "menu": "홈 > 산신 > 실농\n로그인 | 회원가입 | 고객센터\n사람 (43)", "symbols": "^^^^___~~~---+++###$$$", "jamo": "ㄷㄷㄷㄷ ㅠㅠㅠㅠ ㅎㅎㅎ",
    "broken": "�������??????", "mojibake": "ìì£¼ ê´ê³ ëë°±", "hex": "482256d50d41164c842e33f2706bde88dd721099fea2229f", "numbers": "64052 43174 20450 17307",
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate({**PROSE, **JUNK}.items())]
    docs = spark.createDataFrame(rows + [(None, "x", "x")], "doc_id bigint, words string, text string")
    common = spark.createDataFrame([("정말", 1), ("The", 2), (None, 3)], "word string, word_rank int")
    names = {i: k for i, k, _ in rows}
    return {c: {names[r.doc_id]: r for r in quality(docs, common, chunk=c).collect()} for c in (1 << 18, 5)}


@pytest.mark.parametrize("name", [*PROSE, *JUNK])
def test_kind(judged, name):
    assert judged[1 << 18][name].is_prose == (name in PROSE)


def test_chunks_change_nothing(judged):
    assert judged[5] == judged[1 << 18]


def test_statistics(judged):
    r = judged[1 << 18]["english"]
    assert (r.words, r.punctuated_share, round(r.common_share, 6)) == (18, 0.5, round(4 / 18, 6))
    assert judged[1 << 18]["blank"].words == 0 and judged[1 << 18]["blank"].mean_word_length == 0


@given(st.text("가은 .,\n>-|=1aㅋ\t", max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=8), st.randoms())
@settings(max_examples=500, deadline=None)
def test_merge_is_associative(text, cuts, rnd):
    text = prepared(text)
    parts, i = [], 0
    for c in cuts:
        parts.append(text[i : i + c])
        i += c
    parts = [Text.load(Text.of(p, LEX).dump()) for p in [*parts, text[i:]]]
    while len(parts) > 1:
        k = rnd.randrange(len(parts) - 1)
        parts[k : k + 2] = [parts[k].merge(parts[k + 1], LEX)]
    assert parts[0].sums(LEX) == Text.of(text, LEX).sums(LEX) == whole_sums(text, LEX)


def test_very_long_text_and_empty_table(spark):
    rnd = random.Random(1)
    line = " ".join(rnd.choice(["사람은", "정말", "집에", "갔습니다."]) for _ in range(30_000))
    docs = spark.createDataFrame([(1, line + "\n" + line), (1, line + "\n" + line)], "doc_id int, text string")
    common = spark.createDataFrame([("정말", 1)], "word string, word_rank int")
    got = quality(docs, common, chunk=4096).collect()
    assert len(got) == 1 and got[0].words == 60_000 and got[0].is_prose
    assert quality(docs.limit(0), common).count() == 0
    assert Text.of(prepared(line), LEX).sums(LEX)[LINES] == 1
