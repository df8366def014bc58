"""Korean spelling to predicted pronunciation, romanization and IPA as JVM expressions.

Every rule at the boundary of two syllables reads the coda before it, the onset and vowel after it and whether a verb stem ends there,
and writes only that coda and that onset. So the whole ordered set of rules is one table of 28 x 19 x 2 x 2 entries, compiled on
the driver for the rules that are switched on (`boundary_table`); a word is then a `transform` over its syllables with two look-ups
each, however many rules there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import packed_tagged, split_ws

# Letters in the order of their code points, their romanization, and the sound changes as published.
ONSETS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
CODAS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
ONSET_ROMAN = ["G", "KK", "N", "D", "TT", "R", "M", "B", "PP", "S", "SS", "", "J", "JJ", "CH", "K", "T", "P", "H"]
VOWEL_ROMAN = "A AE YA YAE EO E YEO YE O WA WAE OE YO U WO WE WI YU EU UI I".split()
CODA_SPELLED = " k kk ks n nj nh t l lk lm lp ls lt lph lh m p ps s ss ng j ch kh th ph h".split(" ")
CODA_SPOKEN = {"": "", "ㄱ": "k", "ㄴ": "n", "ㄷ": "t", "ㄹ": "l", "ㅁ": "m", "ㅂ": "p", "ㅇ": "ng"}
PLAIN_STOP = {"ㄱ": "ㄱ", "ㅋ": "ㄱ", "ㄲ": "ㄱ", "ㄷ": "ㄷ", "ㅅ": "ㄷ", "ㅆ": "ㄷ", "ㅈ": "ㄷ", "ㅊ": "ㄷ", "ㅌ": "ㄷ", "ㅎ": "ㄷ", "ㅂ": "ㅂ", "ㅍ": "ㅂ"}
CLUSTER = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}
KEPT_OF_CLUSTER = {"ㄺ": "ㄱ", "ㄻ": "ㅁ", "ㄿ": "ㅂ"}  # the second letter stays; of all others the first
TENSE = {"ㄱ": "ㄲ", "ㄷ": "ㄸ", "ㅂ": "ㅃ", "ㅅ": "ㅆ", "ㅈ": "ㅉ"}
ASPIRATED = {"ㄱ": "ㅋ", "ㄷ": "ㅌ", "ㅂ": "ㅍ", "ㅈ": "ㅊ", "ㅅ": "ㅆ"}
NASAL = {"ㄱ": "ㅇ", "ㄷ": "ㄴ", "ㅂ": "ㅁ"}
STEM_TAGS, ENDING_TAGS = ["VV", "VA", "VX", "VCP", "VCN"], ["EC", "EP", "EF", "ETM", "ETN", "EG"]
STEM_CODAS, STEM_ONSETS = "ㄴㅁㄵㄻㄼㄾ", "ㄱㄷㅅㅈ"
PLACEHOLDER = "∅"
#: Rules in their order; each can be switched off.
RULES = ("aspiration", "h_deletion", "palatalization", "liaison", "neutralize", "cluster", "nasal_assim", "fortis", "stem_fortis")
CONSONANT_IPA = {
    "G": "k", "KK": "k{t}", "N": "n", "D": "t", "TT": "t{t}", "R": "ɾ", "M": "m", "B": "p", "PP": "p{t}", "S": "s", "SS": "s{t}", "J": "tɕ", "JJ": "tɕ{t}",
    "CH": "tɕʰ", "K": "kʰ", "T": "tʰ", "P": "pʰ", "H": "h", "NG": "ŋ", "k": "k̚", "n": "n", "t": "t̚", "l": "l", "m": "m", "p": "p̚", "ng": "ŋ", "L": "l",
}
VOWEL_IPA = {
    "A": "a", "AE": "ɛ", "YA": "ja", "YAE": "jɛ", "EO": "ʌ", "E": "e", "YEO": "jʌ", "YE": "je", "O": "o", "WA": "wa", "WAE": "wɛ", "OE": "we", "YO": "jo", "U": "u", "WO": "wʌ",
    "WE": "we", "WI": "wi", "YU": "ju", "EU": "ɯ", "UI": "ɰi", "I": "i",
}


def ipa_map(tense: str = "*") -> dict[str, str]:
    """Romanized sound to IPA; ``tense`` is the mark of tense consonants."""
    return {k: v.replace("{t}", tense) for k, v in {**CONSONANT_IPA, **VOWEL_IPA}.items()}


def stop_of(coda: str) -> str:
    """The plain stop as which a single coda is spoken, else the coda itself."""
    return PLAIN_STOP.get(coda, coda)


def spoken_coda(coda: str, on: frozenset[str]) -> str:
    if coda in CLUSTER:
        return KEPT_OF_CLUSTER.get(coda, CLUSTER[coda][0]) if "cluster" in on else coda
    return stop_of(coda) if "neutralize" in on else coda


def boundary(coda: str, onset: str, before_i: bool, stem_end: bool, on: frozenset[str]) -> tuple[str, str]:
    """(coda, onset) as spoken at the boundary of two syllables."""
    h_part = CLUSTER[coda][0] if coda in ("ㄶ", "ㅀ") else ""  # what a coda with ㅎ leaves behind
    if "aspiration" in on:
        if coda in ("ㅎ", "ㄶ", "ㅀ") and onset in "ㄱㄷㅈㅅ":
            coda, onset = h_part, ASPIRATED[onset]
        elif onset == "ㅎ" and coda not in CLUSTER and stop_of(coda) in ("ㄱ", "ㄷ", "ㅂ"):
            coda, onset = "", ASPIRATED[stop_of(coda)]
    if "h_deletion" in on and onset == "ㅇ" and coda in ("ㅎ", "ㄶ", "ㅀ"):
        coda = h_part
    if "palatalization" in on and before_i and coda in ("ㄷ", "ㅌ") and onset in ("ㅇ", "ㅎ"):
        coda, onset = "", "ㅈ" if (coda, onset) == ("ㄷ", "ㅇ") else "ㅊ"
    if "liaison" in on and onset == "ㅇ" and coda not in ("", "ㅇ"):
        if coda in CLUSTER and coda not in ("ㄶ", "ㅀ"):
            coda, onset = CLUSTER[coda]
        elif coda not in CLUSTER:
            coda, onset = "", coda
    coda = spoken_coda(coda, on)
    if "nasal_assim" in on:
        if coda + onset in ("ㄴㄹ", "ㄹㄴ"):
            coda, onset = "ㄹ", "ㄹ"
        elif coda in NASAL and onset in "ㄴㅁ":
            coda = NASAL[coda]
    if "fortis" in on and onset in TENSE and (coda in ("ㄱ", "ㄷ", "ㅂ") or stem_end and "stem_fortis" in on and onset in STEM_ONSETS):
        onset = TENSE[onset]
    return coda, onset


def _letters(codas: str = CODAS) -> list[str]:
    return [c.strip() for c in codas]


@cache
def boundary_table(on: frozenset[str] = frozenset(RULES)) -> tuple[list[int], list[int]]:
    """(coda * 19 + onset for each ((coda * 19 + onset) * 2 + before_i) * 2 + stem_end; spoken coda of each last coda)."""
    codas = _letters()
    cell = lambda c, o, i, g: (lambda r: codas.index(r[0]) * 19 + ONSETS.index(r[1]))(boundary(c, o, i, g, on))
    return [cell(c, o, bool(i), bool(g)) for c in codas for o in ONSETS for i in (0, 1) for g in (0, 1)], [codas.index(spoken_coda(c, on)) for c in codas]


def _array(xs: list) -> Column:
    """A constant array by one call to the JVM; the optimizer folds it into one literal."""
    return F.expr("array(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in xs) + ")")


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("int")


def syllable_codes(word: Column) -> Column:
    """Code points less 44032 of the Hangul syllables of a word; other characters are dropped."""
    chars = F.split(F.regexp_replace(word, "[^가-힣]", ""), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c) - 44032)


def compose_codes(codes: Column) -> Column:
    """The text of syllable codes (`syllable_codes` undone)."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.hex((c + 44032).cast("bigint"))), "")), "UTF-16BE")


def is_hangul_word(word: Column) -> Column:
    """Whether a word without its punctuation is Hangul syllables throughout, one at least."""
    inside = F.regexp_replace(word, r"""[.,?!~…"'`()\[\]{}<>《》「」『』·:;/\\–—\s-]""", "")
    return inside.rlike("^[가-힣]+$")


def spoken_codes(codes: Column, gaps: Column | None = None, on: frozenset[str] = frozenset(RULES)) -> Column:
    """Syllable codes as spoken. ``gaps`` holds the indices of syllables that end a verb stem before an ending."""
    table, last = (_array(x) for x in boundary_table(on))

    def at(i: Column) -> Column:
        """coda * 19 + onset at the boundary after syllable i."""
        this, after = F.get(codes, i), F.get(codes, i + 1)
        before_i = (_div(after % 588, 28) == 20).cast("int")
        stem = F.array_contains(gaps, i).cast("int") if gaps is not None else F.lit(0)
        return F.get(table, ((this % 28 * 19 + _div(after, 588)) * 2 + before_i) * 2 + stem)

    def one(s: Column, i: Column) -> Column:
        onset = F.when(i == 0, _div(s, 588)).otherwise(at(i - 1) % 19)
        coda = F.when(i == F.size(codes) - 1, F.get(last, s % 28)).otherwise(_div(at(i), 19))
        return onset * 588 + _div(s % 588, 28) * 28 + coda

    return F.transform(codes, one)


def romanized(codes: Column, spelled: bool = False, sound: str = " ", syllable: str = " _ ", names: Callable[[str], str] = str) -> Column:
    """Sounds of each syllable joined by ``sound``, syllables by ``syllable``; spelled codas keep their letters, spoken ones are seven."""
    codas = CODA_SPELLED if spelled else [CODA_SPOKEN.get(c, "") for c in _letters()]
    onset, vowel, coda = (_array([names(x) if x else "" for x in xs]) for xs in (ONSET_ROMAN, VOWEL_ROMAN, codas))

    def one(s: Column) -> Column:
        sounds = F.array(F.get(onset, _div(s, 588)), F.get(vowel, _div(s % 588, 28)), F.get(coda, s % 28))
        return F.array_join(F.filter(sounds, lambda x: x != ""), sound)

    return F.array_join(F.transform(codes, one), syllable)


def to_ipa(roman: Column, table: dict[str, str], sound: str = "") -> Column:
    """IPA of romanized words (``|``, ``_`` and spaces between words, syllables and sounds); unknown sounds show as ``⟨x⟩``."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    phone = lambda t: F.coalesce(F.try_element_at(known, t), F.concat(F.lit("⟨"), t, F.lit("⟩")))
    syl = lambda s: F.array_join(F.transform(split_ws(s), phone), sound)
    word = lambda w: F.when(w == PLACEHOLDER, w).otherwise(F.array_join(F.filter(F.transform(F.split(w, " _ "), syl), lambda x: x != ""), "_"))
    return F.array_join(F.transform(F.split(roman, r" \| "), word), " | ")


def stem_gaps(word_codes: Column, morphs: Column) -> Column:
    """Indices of syllables at which a verb stem meets an ending that turns tense. morphs: ``m/TAG`` texts of the word.

    Only where the morphs have as many syllables as the word; irregular forms have none.
    """
    stem = _array([_letters().index(c) for c in STEM_CODAS])
    soft = _array([ONSETS.index(o) for o in STEM_ONSETS])
    none = F.array().cast("array<int>")

    def part(m: Column) -> Column:
        codes = syllable_codes(F.regexp_extract(m, r"(?s)^(.*)/([^/]*)$", 1))
        return F.struct(F.size(codes).alias("n"), F.get(codes, 0).alias("first"), F.get(codes, F.size(codes) - 1).alias("last"), F.regexp_extract(m, r"(?s)^(.*)/([^/]*)$", 2).alias("tag"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["n"] > 0) & (p["n"] > 0) & acc["tag"].isin(STEM_TAGS) & p["tag"].isin(ENDING_TAGS)
        fits = fits & F.array_contains(stem, acc["last"] % 28) & F.array_contains(soft, _div(p["first"], 588))
        gaps = F.when(fits, F.concat(acc["gaps"], F.array(acc["pos"] - 1))).otherwise(acc["gaps"])
        return F.struct((acc["pos"] + p["n"]).alias("pos"), p["n"].alias("n"), p["last"].alias("last"), p["tag"].alias("tag"), gaps.alias("gaps"))

    # one fold over the morphs carries the position and the morph before
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("last"), F.lit("").alias("tag"), none.alias("gaps"))
    parts = F.transform(F.coalesce(morphs, F.array().cast("array<string>")), part)
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["pos"] == F.size(word_codes), acc["gaps"]).otherwise(none))


SPOKEN_SCHEMA = "form_roman string, pron_pred_hangul string, pron_pred_roman string, pron_pred_ipa string"
_STEM = re.compile(r"(?s)^(.*)/([^/]*)$")
_NOT_SPOKEN = re.compile("[^가-힣]")
_MARKS = re.compile(r"""[.,?!~…"'`()\[\]{}<>《》「」『』·:;/\\–—\s-]""")
#: Words that a worker remembers; beyond it the memory starts anew.
MEMORY = 200_000


class Speaker:
    """Words as spoken, by the same tables as the column functions. Texts repeat their words, so each distinct pair of a word and its
    analysis is spoken once per worker and looked up from then on; the memory is bounded and never travels."""

    def __init__(self, on: frozenset[str], tense: str, ipa_sound: str):
        self.on, self.tense, self.ipa_sound = on, tense, ipa_sound
        self.table, self.last = boundary_table(on)
        ipa = ipa_map(tense)
        names = lambda xs: [ipa.get(x, f"⟨{x}⟩") if x else "" for x in xs]
        spoken = [CODA_SPOKEN.get(c, "") for c in _letters()]
        self.spelled = (ONSET_ROMAN, VOWEL_ROMAN, CODA_SPELLED)
        self.roman = (ONSET_ROMAN, VOWEL_ROMAN, spoken)
        self.ipa = (names(ONSET_ROMAN), names(VOWEL_ROMAN), names(spoken))
        self.stems = {_letters().index(c) for c in STEM_CODAS}
        self.soft = {ONSETS.index(o) for o in STEM_ONSETS}
        self.memory: dict[tuple, tuple[str, str, str, str]] = {}

    def __reduce__(self):
        return Speaker, (self.on, self.tense, self.ipa_sound)

    def gaps(self, codes: list[int], morphs: tuple[str, ...]) -> set[int]:
        """`stem_gaps` of one word."""
        found, pos, before = set(), 0, None
        for m in morphs:
            cut = _STEM.match(m)
            own = [ord(ch) - 44032 for ch in _NOT_SPOKEN.sub("", cut[1])] if cut else []
            tag = cut[2] if cut else ""
            if before and own and before[1] in STEM_TAGS and tag in ENDING_TAGS and before[0] % 28 in self.stems and own[0] // 588 in self.soft:
                found.add(pos - 1)
            pos += len(own)
            before = (own[-1], tag) if own else None
        return found if pos == len(codes) else set()

    def word(self, word: str, morphs: tuple[str, ...] | None) -> tuple[str, str, str, str]:
        key = (word, morphs)
        out = self.memory.get(key)
        if out is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[key] = out = self.speak(word, morphs)
        return out

    def speak(self, word: str, morphs: tuple[str, ...] | None) -> tuple[str, str, str, str]:
        bare = _MARKS.sub("", word)
        if not bare or _NOT_SPOKEN.search(bare):
            return (PLACEHOLDER,) * 4
        codes = [ord(ch) - 44032 for ch in _NOT_SPOKEN.sub("", word)]
        gaps = self.gaps(codes, morphs) if morphs is not None else ()
        onset, spoken = codes[0] // 588, []
        for i, s in enumerate(codes):
            if i + 1 < len(codes):
                after = codes[i + 1]
                cell = self.table[((s % 28 * 19 + after // 588) * 2 + (after % 588 // 28 == 20)) * 2 + (i in gaps)]
                coda, following = divmod(cell, 19)
            else:
                coda, following = self.last[s % 28], 0
            spoken.append((onset, s % 588 // 28, coda))
            onset = following
        spelled = [(s // 588, s % 588 // 28, s % 28) for s in codes]
        write = lambda parts, names, sound, syllable: syllable.join(sound.join(x for x in (names[0][o], names[1][v], names[2][c]) if x) for o, v, c in parts)
        return (
            write(spelled, self.spelled, " ", " _ "),
            "".join(chr(44032 + o * 588 + v * 28 + c) for o, v, c in spoken),
            write(spoken, self.roman, " ", " _ "),
            write(spoken, self.ipa, self.ipa_sound, "_"),
        )

    def utterance(self, words: list[str], analysis: list[list[str]] | None) -> tuple[str, str, str, str]:
        said = [self.word(w, tuple(analysis[i]) if analysis is not None else None) for i, w in enumerate(words)]
        roman, hangul, pron, ipa = zip(*said, strict=True) if said else ((), (), (), ())
        return " | ".join(roman), " ".join(hangul), " | ".join(pron), " | ".join(ipa)


def with_pronunciation(df: DataFrame, form: str = "form", tagged: str | None = "tagged", rules: tuple[str, ...] = RULES, tense: str = "*", ipa_sound: str = "") -> DataFrame:
    """Adds n_eojeol, form_roman, pron_pred_hangul, pron_pred_roman, pron_pred_ipa and align_warn.

    Words that aren't Hangul give ``∅``. The analysis is used only if it has as many words as the form; else align_warn says so. A null
    or blank form gives empty texts and 0 words. Words are cut on the JVM; their sounds come from one Arrow function with a memory of
    words (`Speaker`), without a shuffle. `with_pronunciation_columns` does the same by column expressions alone, for short tables.
    """
    speaker = Speaker(frozenset(rules), tense, ipa_sound)

    @F.arrow_udf(SPOKEN_SCHEMA)
    def spoken(words: pa.Array, analysis: pa.Array) -> pa.Array:
        said = [speaker.utterance(w or [], a) for w, a in zip(words.to_pylist(), analysis.to_pylist(), strict=True)]
        cols = list(zip(*said, strict=True)) if said else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in cols], names=_names(SPOKEN_SCHEMA))

    if tagged:
        df = packed_tagged(df, tagged, "_tagged")
    else:
        df = df.withColumn("_tagged", F.lit(None).cast("array<array<string>>"))
    df = df.withColumn("_words", split_ws(form))
    n, m = F.size("_words"), F.coalesce(F.size("_tagged"), F.lit(0))
    used = F.when((n == m) & F.lit("stem_fortis" in rules), F.col("_tagged"))
    df = df.withColumn("n_eojeol", n).withColumn("_said", spoken(F.col("_words"), used))
    df = df.withColumn("align_warn", F.when((m > 0) & (m != n), F.format_string("eojeol_tag_mismatch(%d!=%d)", n, m)).otherwise(""))
    keep = [c for c in df.columns if c not in ("_tagged", "_words", "_said", "align_warn", *_names(SPOKEN_SCHEMA))]
    return df.select(*keep, *[F.col(f"_said.{c}").alias(c) for c in _names(SPOKEN_SCHEMA)], "align_warn")


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def with_pronunciation_columns(df: DataFrame, form: str = "form", tagged: str | None = "tagged", rules: tuple[str, ...] = RULES, tense: str = "*", ipa_sound: str = "") -> DataFrame:
    """`with_pronunciation` by column expressions alone."""
    on = frozenset(rules)
    if tagged:
        df = packed_tagged(df, tagged, "_tagged")
    else:
        df = df.withColumn("_tagged", F.lit(None).cast("array<array<string>>"))
    df = df.withColumn("_words", split_ws(form))
    n, m = F.size("_words"), F.coalesce(F.size("_tagged"), F.lit(0))
    df = df.withColumn("_aligned", (n == m) & F.lit("stem_fortis" in on))
    df = df.withColumn(
        "_codes",
        F.transform(F.col("_words"), lambda w, i: F.when(is_hangul_word(w), F.struct(syllable_codes(w).alias("c"), i.alias("i")))),
    )
    none = F.array().cast("array<int>")
    df = df.withColumn("_gapped", F.transform("_codes", lambda x: F.struct(x["c"].alias("c"), F.when(F.col("_aligned"), stem_gaps(x["c"], F.get("_tagged", x["i"]))).otherwise(none).alias("g"))))
    df = df.withColumn("_spoken", F.transform("_gapped", lambda x: spoken_codes(x["c"], x["g"], on)))
    hangul = lambda c, text: F.when(c.isNotNull(), text).otherwise(PLACEHOLDER)
    df = df.withColumn("n_eojeol", n)
    df = df.withColumn("form_roman", F.array_join(F.transform("_codes", lambda x: hangul(x, romanized(x["c"], spelled=True))), " | "))
    df = df.withColumn("pron_pred_hangul", F.array_join(F.transform("_spoken", lambda c: hangul(c, compose_codes(c))), " "))
    df = df.withColumn("pron_pred_roman", F.array_join(F.transform("_spoken", lambda c: hangul(c, romanized(c))), " | "))
    table = ipa_map(tense)
    # the IPA of a sound needs no look-up at run time: the tables of letters already hold it
    name = lambda r: table.get(r, f"⟨{r}⟩")
    df = df.withColumn("pron_pred_ipa", F.array_join(F.transform("_spoken", lambda c: hangul(c, romanized(c, sound=ipa_sound, syllable="_", names=name))), " | "))
    df = df.withColumn("align_warn", F.when((m > 0) & (m != n), F.format_string("eojeol_tag_mismatch(%d!=%d)", n, m)).otherwise(""))
    return df.drop("_tagged", "_words", "_aligned", "_codes", "_gapped", "_spoken")
