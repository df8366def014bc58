"""Text quality statistics per document, and whether it is natural prose.

A text is a sequence of lines and a line a sequence of words; everything that is counted is a sum over words or characters. So a
chunk of a document is summed up by three parts: the line it begins in, the whole lines inside, the line it ends in. Merging two
chunks joins the last line of one with the first line of the other, and there the last word of one with the first of the other
(`Line.merge`, `Text.merge`): an associative operation, whatever the cuts.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.session import stored

#: Characters of a chunk; chunks merged by one task on each level of the tree; the most common words that are held in memory.
CHUNK, FAN_IN, MAX_COMMON = 1 << 18, 64, 100_000
#: Share of words with a grammatical ending from which a line is a piece of a sentence, alone and for a run of very short lines.
SENTENCE_SHARE, SHORT_SHARE = 0.3, 0.3
#: How much of a line's ends is kept as text, and up to which length an unfinished word is; a longer one is kept as a `long_word`.
KEEP, KEEP_WORD = 64, 256

# Endings of Korean words in sentences (the second set also ends many nouns), English function words, list marks.
_ENDING = re.compile(
    r"(?:은|는|을|를|에|에서|에게|한테|으로|의|까지|부터|보다|하고|지만|거나|든지|는데|은데|다가|면서|니까|려고|아서|어서|고|게|다|요|죠|네|지|까|구나|군|거든)$"
)
_NOUN_LIKE = re.compile(r"(?:이|가|도|만|나|로|와|과|며)$")
_FUNCTION_WORDS = frozenset(
    (
        "a an and are as at be been but by can could did do does for from had has have he her his i if in is it its my no not of on or our "
        "she should so than that the their then there they this to was we were what when where which while who will with would you your"
    ).split()
)
_MARK = re.compile(r"^(?:(?:[-–—•·*▪◦‣○●■□▶◆◇✓✔※+]|\(?\d{1,3}[.)]|\([0-9a-zA-Z가-힣]{1,3}\)|[가-힣ㄱ-ㅎ][.)]|[a-zA-Z][.)]|[①-⑳]|[ivxIVX]{1,4}[.)])(?:\s|$)|[-•·]\w)")
_LABEL = re.compile(r"^((?:\w{1,12}|화자 ?\d+|[Ss]peaker ?\d+) ?[:：])(?:\s|$)")
_KEY_VALUE = re.compile(r"^[\w.]+\s*=\s*\S")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE_END = re.compile(r"[.?!…。]+[\"'”’)\]*]*$")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_KINDS = [re.compile(p) for p in ("[가-힣]", "[A-Za-z]", "[぀-ヿ一-鿿À-ɏͰ-ԯ]", r"\d", "[ㄱ-ㅎㅏ-ㅣ]", "[\x80-\xff]", "�", r"[^\w\s]", r"\|", "\t")]
HANGUL, LATIN, OTHER, DIGIT, JAMO, LATIN1, BROKEN, SYMBOL, BAR, TAB = range(10)
# sums over the words of a line
WORDS, LETTERS, TOKENS, STRONG, WEAK, ENGLISH, COMMA_END, COMMA_IN, TAGGED, EQUALS, PAREN, ARROW, HASH, COMMON, GAPS, CHARS = range(16)
# Sums are fields of this many bits of one integer, so that adding a word is one addition. No text has as many characters.
BITS = 32
BELOW = BITS * 16
SUMS = (1 << BELOW) - 1


def packed(fields: dict[int, int]) -> int:
    return sum(int(x) << (BITS * i) for i, x in fields.items())


def unpacked(x: int, n: int) -> list[int]:
    return list(struct.unpack(f"<{n}I", x.to_bytes(4 * n, "little")))


class Kinds(dict):
    """Character to its packed kinds, filled as characters occur."""

    def __missing__(self, ch: str) -> int:
        self[ch] = x = packed({i: 1 for i, k in enumerate(_KINDS) if k.match(ch)})
        return x


class Words(dict):
    """Word to its packed sums and, above them, the kinds of its characters; filled as words occur. It is bounded, long words aren't kept."""

    def __init__(self, lex: Lexicon):
        self.lex = lex

    def __missing__(self, token: str) -> int:
        lex = self.lex
        kinds = sum(map(lex.kinds.__getitem__, token)) << BELOW
        if len(token) > lex.keep:
            return kinds + packed(long_sums(long_word(token, lex.keep), lex.common))
        if len(self) >= 200_000:
            self.clear()
        self[token] = x = kinds + packed(lex.sums(token))
        return x


class Lexicon:
    """What is known of words: texts repeat them, so most are looked up. The memory never travels."""

    def __init__(self, common: frozenset[str]):
        self.common, self.cache, self.kinds = common, Words(self), Kinds()
        self.keep = max([KEEP_WORD, *map(len, common)])  # any longer word isn't a common one

    def __getstate__(self):
        return self.common

    def __setstate__(self, common):
        self.__init__(common)

    def unfinished(self, word: str) -> str | list:
        return word if len(word) <= self.keep else long_word(word, self.keep)

    def joined(self, a: str | list, b: str | list) -> str | list:
        if not a or not b:
            return a or b
        if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= self.keep:
            return a + b
        return joined_long(*(long_word(w, self.keep) if isinstance(w, str) else w for w in (a, b)), self.keep)

    def word(self, token: str | list) -> int:
        """The packed sums of a word."""
        if len(token) > self.keep:
            token = long_word(token, self.keep)
        if isinstance(token, list):
            return packed(long_sums(token, self.common))
        return self.cache[token] & SUMS

    def kinds_of(self, token: str) -> int:
        """The packed kinds of a word's characters."""
        return sum(map(self.kinds.__getitem__, token)) if len(token) > self.keep else self.cache[token] >> BELOW

    def sums(self, token: str) -> dict[int, int]:
        v = {TOKENS: 1}
        bare = _EDGE.sub("", token)
        if bare:
            v[WORDS], v[LETTERS] = 1, len(bare)
            if "가" <= bare[-1] <= "힣":
                if len(bare) > 1:
                    v[STRONG] = _ENDING.search(bare) is not None
                    v[WEAK] = not v[STRONG] and _NOUN_LIKE.search(bare) is not None
            else:
                v[ENGLISH] = bare.lower() in _FUNCTION_WORDS
            v[COMMON] = bare.lower() in self.common
        v[COMMA_END] = token.endswith(",")
        v[COMMA_IN] = len(re.findall(r"\w,(?=\w)", token))
        v[TAGGED] = re.search(r"[^/\s]/[A-Z]{2,4}(?:[+,.;]|$)", token) is not None
        v[EQUALS] = re.search(r"\w=\S", token) is not None
        v[PAREN] = re.fullmatch(r"\(\d+\)", token) is not None
        v[ARROW] = token == ">"
        v[HASH] = len(token) >= 20 and re.search(r"\d", token) is not None and re.search(r"[a-zA-Z]", token) is not None and re.search(r"[가-힣]", token) is None
        return v


_EDGE_RUN, _COMMA_IN, _TAG, _TAG_END, _EQUALS = (re.compile(p) for p in (r"[\W_]*", r"\w,(?=\w)", r"[^/\s]/[A-Z]{2,4}[+,.;]", r"[^/\s]/[A-Z]{2,4}$", r"\w=\S"))
_REACH = 7  # characters that the patterns inside a word span at most


def long_word(w: str, keep: int) -> list:
    """What `Lexicon.sums` asks of a word, in bounded space: length, first and last characters, edge characters before and after what is
    bare (both are the length if nothing is), the bare word (None beyond ``keep``) and its end, commas inside, tagged, equals sign,
    digits, Latin letters, Hangul. `joined_long` of two words is that of the word they make."""
    n = len(w)
    pre = _EDGE_RUN.match(w).end()
    post = n if pre == n else _EDGE_RUN.match(w[::-1]).end()
    bare = "" if pre == n else w[pre : n - post]
    return [
        n, w[:keep], w[-keep:], pre, post, bare if len(bare) <= keep else None, bare[-3:], len(_COMMA_IN.findall(w)), _TAG.search(w) is not None, _EQUALS.search(w) is not None,
        len(re.findall(r"\d", w)), re.search("[a-zA-Z]", w) is not None, re.search("[가-힣]", w) is not None,
    ]


def joined_long(a: list, b: list, keep: int) -> list:
    n, first, last, pre, post, bare, end, commas, tagged, equals, digits, latin, hangul = a
    n2, first2, last2, pre2, post2, bare2, end2, commas2, tagged2, equals2, digits2, latin2, hangul2 = b
    x, y = last[-_REACH:], first2[:_REACH]
    across = len(_COMMA_IN.findall(x + y)) - len(_COMMA_IN.findall(x)) - len(_COMMA_IN.findall(y))
    left, right = pre < n, pre2 < n2  # whether there is anything bare
    if left and right:
        inside = n - pre + n2 - post2
        # edge characters are in no ending, so one stands for all between
        end2 = ((end if not post + pre2 else "-") + end2)[-3:]
        bare2 = bare + last[len(last) - post :] + first2[:pre2] + bare2 if inside <= keep else None
    elif left:
        bare2, end2 = bare, end
    return [
        n + n2, (first + first2)[:keep], (last + last2)[-keep:], pre if left else n + pre2, post2 if right else n2 + post, bare2, end2, commas + commas2 + across, tagged or tagged2 or _TAG.search(x + y) is not None,
        equals or equals2 or _EQUALS.search(x + y) is not None, digits + digits2, latin or latin2, hangul or hangul2,
    ]


def long_sums(w: list, common: frozenset[str]) -> dict[int, int]:
    """`Lexicon.sums` of a `long_word`."""
    n, first, last, pre, post, bare, end, commas, tagged, equals, digits, latin, hangul = w
    v = {TOKENS: 1, COMMA_END: last.endswith(","), COMMA_IN: commas, TAGGED: tagged or _TAG_END.search(last) is not None, EQUALS: equals}
    if pre < n:
        v[WORDS], v[LETTERS] = 1, n - pre - post
        if "가" <= end[-1] <= "힣":
            if v[LETTERS] > 1:
                v[STRONG] = _ENDING.search(end) is not None
                v[WEAK] = not v[STRONG] and _NOUN_LIKE.search(end) is not None
        else:
            v[ENGLISH] = bare is not None and bare.lower() in _FUNCTION_WORDS
        v[COMMON] = bare is not None and bare.lower() in common
    v[PAREN] = first[0] == "(" and last[-1] == ")" and 0 < digits == n - 2
    v[HASH] = n >= 20 and digits > 0 and latin and not hangul
    return v


class Line:
    """A piece of a line: sums over characters and over the words that end inside it, and as text what a neighbour may change."""

    __slots__ = ("kinds", "sums", "head", "tail", "lead", "trail", "blank", "start", "end")

    def __init__(self, kinds, sums, head, tail, lead, trail, blank, start, end):
        # blank: the white space at the beginning, start: what follows it, end: what stands before the white space at the end, each cut to KEEP
        # head: the word that touches the beginning ('' if the piece begins with white space); tail likewise at the end, None if head reaches the end
        self.kinds, self.sums, self.head, self.tail, self.lead, self.trail, self.blank, self.start, self.end = kinds, sums, head, tail, lead, trail, blank, start, end

    @classmethod
    def of(cls, text: str, lex: Lexicon) -> Line:
        words = text.split()
        # of white space, only tabs and no-break spaces have a kind
        kinds = text.count("\t") * lex.kinds["\t"] + text.count("\xa0") * lex.kinds["\xa0"]
        left, right = text.lstrip(), text.rstrip()
        lead, trail = len(text) - len(left), len(text) - len(right)
        ends = text[: min(lead, KEEP)], left[:KEEP], right[-KEEP:]
        sums = len(text) << (BITS * CHARS)
        if not words:
            return cls(kinds, sums, "", None if not text else "", lead, 0, *ends)
        if "   " in text:
            sums += len(re.findall(r"\S {3,}(?=\S)", text)) << (BITS * GAPS)
        head = words.pop(0) if not lead else ""
        if not words and not trail and head:
            return cls(kinds + lex.kinds_of(head), sums, lex.unfinished(head), None, 0, 0, *ends)
        tail = words.pop() if not trail else ""
        whole = sum(map(lex.cache.__getitem__, words))
        sums += whole & SUMS
        kinds += (whole >> BELOW) + lex.kinds_of(head) + lex.kinds_of(tail)
        return cls(kinds, sums, lex.unfinished(head), lex.unfinished(tail), lead, trail, *ends)

    def merge(self, o: Line, lex: Lexicon) -> Line:
        kinds, sums = self.kinds + o.kinds, self.sums + o.sums
        blank = self.blank if self.start else (self.blank + o.blank)[:KEEP]
        start = (self.start + o.blank + o.start)[:KEEP] if self.start else o.start
        end = (self.end + " " * min(self.trail, KEEP) + o.end)[-KEEP:] if o.end else self.end
        if self.tail is None and o.tail is None:
            return Line(kinds, sums, lex.joined(self.head, o.head), None, self.lead, o.trail, blank, start, end)
        if self.tail is None:
            return Line(kinds, sums, lex.joined(self.head, o.head), o.tail, self.lead if self.head else o.lead, o.trail, blank, start, end)
        if o.tail is None:
            return Line(kinds, sums, self.head, lex.joined(self.tail, o.head), self.lead, self.trail if not o.head else 0, blank, start, end)
        word = lex.joined(self.tail, o.head)
        if word:
            sums += lex.word(word)
        if (not word or not self.tail or not o.head) and self.trail + o.lead >= 3:
            sums += 1 << (BITS * GAPS)
        return Line(kinds, sums, self.head, o.tail, self.lead, o.trail, blank, start, end)

    def closed(self, lex: Lexicon) -> tuple[list[int], list[int]]:
        sums = self.sums + sum(lex.word(w) for w in (self.head, self.tail) if w)
        return unpacked(self.kinds, 10), unpacked(sums, 16)

    def state(self) -> list:
        return [getattr(self, s) for s in self.__slots__]


def line_class(kinds: list[int], v: list[int], start: str) -> str:
    """prose, short (too short to tell by itself), list, table or noise."""
    text = re.sub(r"^(?:>\s*)+", "", start.strip())
    quoted = text != start.strip()
    text = _EDGE_QUOTES.sub("", text.replace("**", "")).strip()
    letters = kinds[HANGUL] + kinds[LATIN] + kinds[OTHER]
    ink = v[CHARS]
    if _MARK.match(text):
        return "list"
    if kinds[TAB] or kinds[BAR] >= 2 or (v[GAPS] and kinds[DIGIT] and v[GAPS] * 2 >= v[TOKENS] - 1):
        return "table"
    if _KEY_VALUE.match(text) or v[EQUALS] >= 2 or (v[COMMA_IN] >= 2 and v[TOKENS] <= 2) or v[TAGGED] * 2 >= max(1, v[TOKENS]):
        return "table"
    if (v[ARROW] >= 2 and 2 * v[ARROW] + 1 >= v[TOKENS] and not quoted) or (v[PAREN] and v[TOKENS] == 2):
        return "list"
    if kinds[BROKEN] * 10 > ink or kinds[LATIN1] * 3 > ink or kinds[JAMO] * 2 > ink or letters * 2 < ink or (v[HASH] and v[TOKENS] <= 3):
        return "noise"
    words, strong, weak, english = v[WORDS], v[STRONG], v[WEAK], v[ENGLISH]
    label = _LABEL.match(text)
    if label:
        own = unpacked(sum(map(_PLAIN.word, label[1].split())), 16)
        words, strong, weak, english = words - own[WORDS], strong - own[STRONG], weak - own[WEAK], english - own[ENGLISH]
    tokens = v[TOKENS] - (len(label[1].split()) if label else 0)
    if tokens >= 3 and v[COMMA_END] >= tokens - 1:
        return "list"
    if words <= 0:
        return "noise"
    if words <= 2:
        return "short"
    return "prose" if strong + 0.5 * weak + english >= SENTENCE_SHARE * words else "list"


_PLAIN = Lexicon(frozenset())
_EDGE_QUOTES = re.compile("^[\"'“”‘’]+")
# sums over the lines of a text
LINES, PROSE, SHORT, SHORT_STRONG, PUNCTUATED, N_WORDS, N_LETTERS, N_COMMON, N_INK, N_SYMBOL = range(10)


def count_line(total: list[int], kinds: list[int], v: list[int], start: str, end: str) -> None:
    total[N_WORDS] += v[WORDS]
    total[N_LETTERS] += v[LETTERS]
    total[N_COMMON] += v[COMMON]
    total[N_INK] += v[CHARS]
    total[N_SYMBOL] += kinds[SYMBOL]
    if not v[TOKENS]:
        return
    total[LINES] += 1
    ended = _SENTENCE_END.search(end.rstrip()) is not None
    total[PUNCTUATED] += ended
    kind = line_class(kinds, v, start)
    total[PROSE] += kind == "prose"
    if kind == "short":
        total[SHORT] += 1
        total[SHORT_STRONG] += bool(v[STRONG] + v[ENGLISH] or ended)


def add_line(total: list[int], line: Line, lex: Lexicon) -> None:
    count_line(total, *line.closed(lex), line.start, line.end)


def add_whole(total: list[int], text: str, lex: Lexicon) -> None:
    """`add_line` of a whole line."""
    words = text.split()
    if not words:
        total[N_INK] += len(text)
        return
    both = sum(map(lex.cache.__getitem__, words))
    v, kinds = unpacked(both & SUMS, 16), unpacked(both >> BELOW, 10)
    v[CHARS] = len(text)
    if "   " in text:
        v[GAPS] = len(re.findall(r"\S {3,}(?=\S)", text))
    kinds[TAB] = text.count("\t")
    kinds[LATIN1] += text.count("\xa0")
    count_line(total, kinds, v, text.lstrip()[:KEEP], text.rstrip()[-KEEP:])


def whole_sums(text: str, lex: Lexicon) -> list[int]:
    """The sums of a whole text, line by line; `Text` gives the same from chunks."""
    total = [0] * 10
    for x in text.split("\n"):
        add_whole(total, x, lex)
    return total


class Text:
    """A chunk of a text: its first line, the sums over whole lines after it, and its last line (None if it is the first)."""

    def __init__(self, first: Line, total: list[int], last: Line | None):
        self.first, self.total, self.last = first, total, last

    @classmethod
    def of(cls, text: str, lex: Lexicon) -> Text:
        lines = text.split("\n")
        total = [0] * 10
        for x in lines[1:-1]:
            add_whole(total, x, lex)
        return cls(Line.of(lines[0], lex), total, Line.of(lines[-1], lex) if len(lines) > 1 else None)

    def merge(self, o: Text, lex: Lexicon) -> Text:
        total = [a + b for a, b in zip(self.total, o.total, strict=True)]
        if self.last is None:
            return Text(self.first.merge(o.first, lex), total, o.last)
        joined = self.last.merge(o.first, lex)
        if o.last is None:
            return Text(self.first, total, joined)
        add_line(total, joined, lex)
        return Text(self.first, total, o.last)

    def dump(self) -> str:
        return json.dumps([self.first.state(), self.total, self.last and self.last.state()], ensure_ascii=False)

    @classmethod
    def load(cls, s: str) -> Text:
        first, total, last = json.loads(s)
        return cls(Line(*first), total, last and Line(*last))

    def sums(self, lex: Lexicon) -> list[int]:
        total = list(self.total)
        add_line(total, self.first, lex)
        if self.last is not None:
            add_line(total, self.last, lex)
        return total


def prepared(text: str) -> str:
    """Composed, one kind of line end, without invisible characters. Every step works alike on a whole text and on its chunks,
    but for composition and CR LF, so it comes before the cut."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _INVISIBLE.sub("", text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace("\x0b", " ").replace("\x0c", " ").replace("\x85", "\n"))


COUNTS = ["lines", "prose_lines", "short_lines", "short_strong", "punctuated", "words", "letters", "common", "ink", "symbols"]
_RAW = "doc_id bigint, part int, parts int, text string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _first_pass(lex: Lexicon, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = prepared(text or "")
                if len(text) <= chunk:
                    rows.append((doc_id, 0, 1, None, *whole_sums(text, lex)))
                else:
                    n = -(-len(text) // chunk)
                    rows.extend((doc_id, i, n, text[i * chunk : (i + 1) * chunk], *[None] * 10) for i in range(n))
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 10]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "part", "parts", "text", *COUNTS])

    return run


def _chunk_states(lex: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = [Text.of(t, lex).dump() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("parts"), pa.array(states, pa.string())], names=["doc_id", "part", "parts", "state"])

    return run


def _merge_group(lex: Lexicon):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        texts = [Text.load(s) for s in pdf["state"]]
        whole = texts[0]
        for t in texts[1:]:
            whole = whole.merge(t, lex)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // FAN_IN], "parts": [-(-int(pdf["parts"].iloc[0]) // FAN_IN)], "state": [whole.dump()]})

    return run


def text_counts(documents: DataFrame, common_words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, counts…) per document. Texts up to ``chunk`` characters are finished where they are read. Longer ones are cut, their
    chunks are spread over the cluster and merged as a tree of fan-in FAN_IN, each level one shuffle of small states."""
    words = common_words.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(MAX_COMMON + 1).collect()  # a fixed table, bounded
    if len(words) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    lex = Lexicon(frozenset(r.word for r in words))
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    read = stored(docs.mapInArrow(_first_pass(lex, chunk), _RAW), "text-counts")
    small = read.where("parts = 1").select("doc_id", *COUNTS)
    longest = read.agg(F.max("parts")).first()[0] or 1
    if longest == 1:
        return small
    schema = "doc_id bigint, part int, parts int, state string"
    level = read.where("parts > 1").select("doc_id", "part", "parts", "text").dropDuplicates(["doc_id", "part"]).repartition("doc_id", "part").mapInArrow(_chunk_states(lex), schema)
    while longest > 1:
        level = level.groupBy("doc_id", F.floor(F.col("part") / FAN_IN).alias("of")).applyInPandas(_merge_group(lex), schema)
        longest = -(-longest // FAN_IN)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [Text.load(s).sums(lex) for s in b.column("state").to_pylist()]
            if sums:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*sums, strict=True))], names=["doc_id", *COUNTS])

    return small.unionByName(level.mapInArrow(finish, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)))


def quality(documents: DataFrame, common_words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per document: words, mean_word_length, symbol_ratio, punctuated_share, common_share, prose_share, is_prose.

    A line counts as prose if enough of its words have the endings or function words of sentences and it isn't marked as a list item,
    laid out as data, or noise. Lines of one or two words are judged together. A document is natural prose unless it is blank or more
    than half of its lines that aren't blank are something else. Null texts count as blank; ratios over nothing are 0; rows without
    doc_id are left out; a doc_id given twice with equal rows may appear twice.
    """
    c = text_counts(documents, common_words, chunk)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    short = F.when(F.col("short_strong") >= SHORT_SHARE * F.col("short_lines"), F.col("short_lines")).otherwise(0)
    prose = F.col("prose_lines") + short
    return c.select(
        "doc_id",
        F.col("words"),
        ratio("letters", "words").alias("mean_word_length"),
        ratio("symbols", "ink").alias("symbol_ratio"),
        ratio("punctuated", "lines").alias("punctuated_share"),
        ratio("common", "words").alias("common_share"),
        F.coalesce(F.try_divide(prose, F.col("lines")), F.lit(0.0)).alias("prose_share"),
        ((F.col("lines") > 0) & ((F.col("lines") - prose) * 2 <= F.col("lines"))).alias("is_prose"),
    )
