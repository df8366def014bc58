import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterlake.llm.quality import LETTERS, N_LETTERS, N_WORDS, PROSE, PUNCTUATED, Lexicon, Text, long_sums, long_word, joined_long, unpacked

LEX = Lexicon(frozenset({"the", "정말"}))


def in_chunks(text, n):
    parts = [Text.load(Text.of(text[i : i + n], LEX).dump()) for i in range(0, len(text), n)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p, LEX)
    return whole.sums(LEX)


@pytest.mark.parametrize("text", ["x" * 100_000, "a " + "x" * 100_000 + " b", "字" * 5000 + " b", "a " + "字" * 5000])
def test_every_letter_of_a_long_word_counts(text):
    whole = Text.of(text, LEX).sums(LEX)
    assert (whole[N_WORDS], whole[N_LETTERS]) == (len(text.split()), len(text.replace(" ", "")))
    assert in_chunks(text, 999) == in_chunks(text, 17) == whole


def test_padding_hides_no_ends():
    pad, said = " " * 70, "사람은 정말 집에 갔습니다. " * 60
    lines = [said, "- " + said, "The word is in the house of a friend. " * 30]
    plain = Text.of("\n".join(x.strip() for x in lines), LEX).sums(LEX)
    text = "\n".join(pad + x.strip() + pad for x in lines)
    padded = Text.of(text, LEX).sums(LEX)
    assert (padded[PROSE], padded[PUNCTUATED]) == (plain[PROSE], plain[PUNCTUATED]) == (2, 3)
    for n in (7, 64, 333):
        assert in_chunks(text, n) == padded


@given(st.lists(st.text("가은의a1(),=/+-_AB>", max_size=12), min_size=2, max_size=8), st.integers(1, 12))
@settings(max_examples=2000, deadline=None)
def test_long_word_is_that_of_its_pieces(pieces, keep):
    """Any cuts give the sums of the whole word."""
    pieces = [p for p in pieces if p] or ["a"]
    keep += 8
    got = long_word(pieces[0], keep)
    for p in pieces[1:]:
        got = joined_long(got, long_word(p, keep), keep)
    word = "".join(pieces)
    assert got[:6] == long_word(word, keep)[:6] and got[7:] == long_word(word, keep)[7:]
    if len(word) > keep:
        want = {k: int(v) for k, v in LEX.sums(word).items() if v}
        assert {k: int(v) for k, v in long_sums(got, LEX.common).items() if v} == want
    assert unpacked(LEX.word("가" * 300), 16)[LETTERS] == 300
