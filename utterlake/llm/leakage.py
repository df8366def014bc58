"""Held-out passages in training text: pigeonhole pieces, exact piece hits, Myers bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import compose

#: Characters of a passage that count as a leak, and the edits allowed within them.
WINDOW, MAX_ERRORS = 40, 2
#: Test items are held in memory block by block; a block never exceeds these bounds.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
SCHEMA = "doc_id bigint, item_id bigint, distance int"


def letters(x: pa.Array) -> pa.Array:
    """Only letters and digits, composed and in lower case, over a whole Arrow array."""
    x = compose(pc.utf8_lower(compose(x)))
    return pc.replace_substring_regex(x, pattern=r"[^\p{L}\p{N}]+", replacement="")


def budget(length: int, window: int, max_errors: int) -> tuple[int, int, int]:
    """(window, errors, piece length) for a text of so many characters.

    Pieces stand at multiples of their length. A window holds at least errors + 1 of them whole wherever it begins, so one is left
    untouched by the errors. Short texts are one window and may have an error per ten characters.
    """
    w = min(window, length)
    k = min(max_errors, w // 10)
    return (w, k, max(1, w // (k + 1))) if length <= window else (w, k, (w + 1) // (k + 2))


def extensions(pattern: str, text: str, k: int) -> list[int]:
    """For each a, the least edit distance of text[:a] to a prefix of pattern, as far as it stays within k.

    Myers' bit vectors hold the vertical differences of a column for all prefixes of the pattern at once; both strings are
    anchored at their start, so the horizontal difference enters the top row as +1.
    """
    best, m = [0], len(pattern)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    mask = (1 << m) - 1
    vp, vn = mask, 0
    for a, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp)
        hn = vp & xh
        hp = (hp << 1) | 1
        hn <<= 1
        vp = (hn | ~(xv | hp)) & mask
        vn = hp & xv & mask
        low = min(max(0, a - k), m)
        part = (1 << low) - 1
        d = a + (vp & part).bit_count() - (vn & part).bit_count()
        least = d
        for i in range(low, min(m, a + k)):
            d += (vp >> i & 1) - (vn >> i & 1)
            least = min(least, d)
        if least > k:
            break
        best.append(least)
    return best


def distance_at(doc: str, start: int, item: str, off: int, q: int, w: int, k: int) -> int | None:
    """The least distance, within k, of a window of the item around a piece that stands in the document at ``start``."""
    end, tail = start + q, off + q
    right = extensions(doc[end : end + w - q + k], item[tail : tail + w - q], k)
    left = extensions(doc[max(0, start - (w - q) - k) : start][::-1], item[max(0, off - (w - q)) : off][::-1], k)
    sums = [left[w - q - b] + right[b] for b in range(max(0, w - q - len(left) + 1), min(len(right), w - q + 1))]
    return min((s for s in sums if s <= k), default=None)


def _matcher(items: list[tuple[int, str]], window: int, max_errors: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple[int, int]]] = {}
        shape = [budget(len(t), window, max_errors) for _, t in items]
        for n, (_, t) in enumerate(items):
            q = shape[n][2]
            for off in range(0, len(t) - q + 1, q):
                pieces.setdefault(t[off : off + q], []).append((n, off))
        machine = ahocorasick.Automaton()
        for p, at in pieces.items():
            machine.add_word(p, (len(p), at))
        machine.make_automaton()
        for b in batches:
            out: dict[tuple[int, int], int] = {}
            for doc_id, text in zip(b.column(0).to_pylist(), letters(b.column(1)).to_pylist(), strict=True):
                for end, (q, hits) in machine.iter(text) if pieces else ():
                    for n, off in hits:
                        key = (doc_id, items[n][0])
                        if out.get(key) != 0:
                            d = distance_at(text, end - q + 1, items[n][1], off, q, shape[n][0], shape[n][1])
                            if d is not None and d < out.get(key, 1 << 30):
                                out[key] = d
            if out:
                yield pa.RecordBatch.from_pydict({"doc_id": [k[0] for k in out], "item_id": [k[1] for k in out], "distance": pa.array(out.values(), pa.int32())})

    return scan


def item_blocks(eval_items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items as normalised texts, block by block; what the driver holds is one block."""
    block: list[tuple[int, str]] = []
    chars = 0
    rows = eval_items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    for r in rows.toLocalIterator():
        t = letters(pa.array([r.text], pa.string()))[0].as_py()
        if t:
            block.append((r.item_id, t))
            chars += len(t)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, eval_items: DataFrame, window: int = WINDOW, max_errors: int = MAX_ERRORS) -> DataFrame:
    """(doc_id, item_id, distance): every document with a passage of ``window`` characters of a test item, or a whole shorter item,
    within ``max_errors`` edits; distance 0 is an exact copy.

    Both texts count by their letters and digits only. Whole documents are read, in one pass per block of items, without a shuffle
    of the documents; the hits of a document that is listed twice are merged. Null texts and ids, and texts without a letter, match
    nothing.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    hits = [docs.mapInArrow(_matcher(block, window, max_errors), SCHEMA) for block in item_blocks(eval_items)]
    if not hits:
        return spark.createDataFrame([], SCHEMA)
    union = hits[0]
    for h in hits[1:]:
        union = union.unionByName(h)
    return union.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def leaked_items(hits: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Per test item the number of documents with an exact and with a near copy."""
    per = hits.groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("exact_docs"), F.count_if(F.col("distance") > 0).alias("near_docs"))
    return eval_items.select(F.col("item_id").cast("bigint").alias("item_id"), "task").join(per, "item_id")
