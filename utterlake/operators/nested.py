"""Deeply nested annotation files into flat, linked tables.

The JVM parses each delivery once into a VARIANT and casts it, tolerant of shape, to typed arrays of sentences and their layers. The
arrays then travel as Arrow buffers, a bounded slice of a document's sentences a row, and every table, that of the sentences too, is
made from the list offsets of its parent: `list_parent_indices` says which parent each child has, keys follow by one vectorised
`take`. No row is walked in Python.

Every table has the keys file_id, doc_no, sent_no (positions from 1) and sentence_id, so children of sentences without an id stay
apart. Word ids are texts; a list of ids travels as its JSON text and is opened on the Arrow side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND_SCHEMA = "layer string, sentence_id string, item_no int, arg_no int, word_id string"
KEYS = "file_id string, doc_no int, sent_no int, sentence_id string"
#: Sentences of a document in one row on their way to Arrow; the engine bounds a batch of rows by bytes.
SLICE = 64


def as_array(v: Column, kind: str) -> Column:
    """A value as an array of ``kind``: a lone value counts as an array of one, null and absent as an empty one. Items that are null or of
    another shape keep their place as nulls. The array is tried first and each value is cast once."""
    lone = F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(F.try_variant_get(v, "$", kind)))
    return F.coalesce(F.try_variant_get(v, "$", f"array<{kind}>"), lone, F.array().cast(f"array<{kind}>"))


def first_of(v: Column, kind: str) -> Column:
    """The first item of an array, or a lone value."""
    return F.coalesce(F.get(F.try_variant_get(v, "$", f"array<{kind}>"), 0), F.try_variant_get(v, "$", kind))


def newest_readable(deliveries: DataFrame, key: str = "file_id", at: str = "received_at", body: str = "body") -> DataFrame:
    """(key, doc): the newest delivery of each file whose body is one JSON object; a leading byte order mark doesn't matter.

    Bodies are parsed before the shuffle and one per file and map task survives the partial aggregation, so a file delivered
    many times costs no more than another. Ties go to the greater hash of the body; rows without key or body, and files without a
    readable delivery, give nothing. A null received_at counts as oldest.
    """
    # what parses and begins with a brace is an object: neither a pattern nor a schema has to be found in the whole text
    text = F.ltrim(F.col(body), F.lit("\ufeff \t\n\r"))
    parsed = (
        deliveries.select(key, at, F.xxhash64(body).alias("h"), text.alias("text"))
        .where(F.col(key).isNotNull() & F.col("text").startswith("{"))
        .select(key, at, "h", F.try_parse_json("text").alias("doc"))
        .where("doc is not null")
    )
    rank = F.struct(F.coalesce(F.col(at).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col("h"))
    return parsed.groupBy(key).agg(F.max_by("doc", rank).alias("doc"))


_WORD = "struct<id:string,form:string>"
_MP = "struct<form:string,label:string,word_id:string>"
_WSD = "struct<form:string,pos:string,sense_id:string,word_id:string>"
_DP = "struct<word_id:string,word_form:string,head:string,label:string>"
_PREDICATE = "struct<form:string,lemma:string,sense_id:string,word_id:string>"


def _frame(f: Column) -> Column:
    def arguments(field: str) -> Column:
        return F.transform(as_array(f[field], _MP), lambda a: F.struct(F.lit(field).alias("role"), a["form"].alias("form"), a["label"].alias("label"), a["word_id"].alias("word_id")))

    return F.struct(first_of(f["predicate"], _PREDICATE).alias("predicate"), F.concat(arguments("argument"), arguments("adjunct")).alias("args"))


def _zero(z: Column) -> Column:
    restored, antecedent = "struct<form:string,type:string>", "struct<form:string,sentence_id:string>"
    parts = F.transform(as_array(z["ellipsis"], "struct<restored:variant,antecedent:variant>"), lambda e: F.struct(first_of(e["restored"], restored).alias("restored"), first_of(e["antecedent"], antecedent).alias("antecedent")))
    return F.struct(first_of(z["predicate"], _PREDICATE).alias("predicate"), parts.alias("parts"))


#: Layer to (its field in a sentence, its typed form).
LAYERS = {
    "word": ("word", lambda v: as_array(v, _WORD)),
    "mp": ("MP", lambda v: as_array(v, _MP)),
    "wsd": ("WSD", lambda v: as_array(v, _WSD)),
    "dp": ("DP", lambda v: as_array(v, _DP)),
    "srl": ("SRL", lambda v: F.transform(as_array(v, "struct<predicate:variant,argument:variant,adjunct:variant>"), _frame)),
    "za": ("ZA", lambda v: F.transform(as_array(v, "struct<predicate:variant,ellipsis:variant>"), _zero)),
}


def typed_documents(docs: DataFrame, layers: tuple[str, ...] = tuple(LAYERS), key: str = "file_id") -> DataFrame:
    """(file_id, doc_no, sent_from, sentences): the documents of every file as typed sentences with the given layers, SLICE to a row, so
    that a row is bounded however large a file is. sent_from counts the sentences before the slice."""
    documents = docs.select(F.col(key).cast("string").alias("file_id"), F.posexplode(as_array(F.try_variant_get("doc", "$.document", "variant"), "struct<sentence:variant>")).alias("doc_no", "d"))
    fields = "".join(f",{LAYERS[x][0]}:variant" for x in layers)
    raw = documents.select("file_id", (F.col("doc_no") + 1).alias("doc_no"), as_array(F.col("d.sentence"), f"struct<id:string,form:string,speaker_id:string{fields}>").alias("s"))
    starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(SLICE))
    sliced = raw.where(F.size("s") > 0).select("file_id", "doc_no", "s", F.explode(starts).alias("sent_from")).withColumn("s", F.slice("s", F.col("sent_from") + 1, F.lit(SLICE)))

    def sentence(s: Column) -> Column:
        own = [LAYERS[x][1](s[LAYERS[x][0]]).alias(x) for x in layers]
        return F.when(s.isNotNull(), F.struct(F.coalesce(s["id"], F.lit("")).alias("sentence_id"), s["form"].alias("form"), s["speaker_id"].alias("speaker_id"), *own))

    return sliced.select("file_id", "doc_no", "sent_from", F.transform("s", sentence).alias("sentences"))


def children(parent: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent index, position from 1, flattened values) of a list array, from its offsets alone."""
    at = pc.list_parent_indices(parent)
    values = pc.list_flatten(parent)
    lengths = pc.fill_null(pc.list_value_length(parent), 0)
    starts = pc.subtract(pc.cumulative_sum(pc.cast(lengths, pa.int64())), pc.cast(lengths, pa.int64()))
    position = pc.add(pc.subtract(pa.array(np.arange(len(at), dtype=np.int64)), pc.take(starts, at)), 1)
    return at, position, values


def id_lists(x: pa.Array) -> pa.ListArray:
    """Word ids as lists of distinct texts in order: a text is one id, the JSON text of a list its items, null and '' none."""
    text = pc.fill_null(x, "").to_numpy(zero_copy_only=False)
    listed = pc.fill_null(pc.starts_with(x, "["), False).to_numpy(zero_copy_only=False)
    single = (text != "") & ~listed
    opened: dict[int, list[str]] = {}
    for i in np.flatnonzero(listed).tolist():
        try:
            items = json.loads(text[i], parse_int=str, parse_float=str)
        except ValueError:
            items = [text[i]]
        texts = (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in items if v is not None)
        opened[i] = list(dict.fromkeys(t for t in texts if t))
    lengths = single.astype(np.int32)
    for i, ids in opened.items():
        lengths[i] = len(ids)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.empty(int(offsets[-1]), dtype=object)
    values[offsets[:-1][single]] = text[single]
    for i, ids in opened.items():
        values[offsets[i] : offsets[i + 1]] = ids
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.string()))


def id_text(x: pa.Array) -> pa.Array:
    """The ids as one text, several joined by ``|``; '' for none. Most arrays hold no list and pass as they are."""
    if not pc.any(pc.starts_with(x, "[")).as_py():
        return pc.fill_null(x, "")
    return pc.binary_join(id_lists(x), "|")


def first_id(x: pa.Array) -> pa.Array:
    if not pc.any(pc.starts_with(x, "[")).as_py():
        return pc.fill_null(x, "")
    return pa.array([ids[0] if ids else "" for ids in id_lists(x).to_pylist()], pa.string())


class Sentences:
    """The sentences of a batch of `typed_documents` with their keys; null items of a document's array keep their place and are left out."""

    def __init__(self, batch: pa.RecordBatch):
        at, no, values = children(batch.column("sentences"))
        real = pc.is_valid(values)
        at, no, self.values = pc.filter(at, real), pc.filter(no, real), pc.filter(values, real)
        sent_no = pc.cast(pc.add(pc.cast(no, pa.int64()), pc.cast(pc.take(batch.column("sent_from"), at), pa.int64())), pa.int32())
        self.id = self.field("sentence_id")
        self.keys = [pc.take(batch.column("file_id"), at), pc.take(batch.column("doc_no"), at), sent_no, self.id]

    def field(self, name: str) -> pa.Array:
        return pc.struct_field(self.values, name)

    def keys_at(self, at: pa.Array) -> list[pa.Array]:
        return [pc.take(k, at) for k in self.keys]


def _rows(layer: str, sentence: pa.Array, item: pa.Array | None, arg: pa.Array | None, word: pa.Array | None) -> pa.RecordBatch:
    n = len(sentence)
    zero = pa.array(np.zeros(n, dtype=np.int32))
    cast = lambda x: zero if x is None else pc.cast(x, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(layer), n), pc.cast(sentence, pa.string()), cast(item), cast(arg), pa.repeat(pa.scalar(""), n) if word is None else pc.cast(word, pa.string())],
        names=["layer", "sentence_id", "item_no", "arg_no", "word_id"],
    )


def link_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The links of all layers: sentence, mp, wsd, srl and srl_arg."""
    s = Sentences(batch)
    yield _rows("sentence", s.id, None, None, None)
    for layer in ("mp", "wsd"):
        at, no, values = children(s.field(layer))
        yield _rows(layer, pc.take(s.id, at), no, None, id_text(pc.struct_field(values, "word_id")))
    at, no, frames = children(s.field("srl"))
    frame_sid = pc.take(s.id, at)
    yield _rows("srl", frame_sid, no, None, first_id(pc.struct_field(pc.struct_field(frames, "predicate"), "word_id")))
    arg_at, arg_no, args = children(pc.struct_field(frames, "args"))
    arg_sid, arg_item = pc.take(frame_sid, arg_at), pc.take(no, arg_at)
    word_ids = id_lists(pc.struct_field(args, "word_id"))
    word_at, _, words = children(word_ids)
    yield _rows("srl_arg", pc.take(arg_sid, word_at), pc.take(arg_item, word_at), pc.take(arg_no, word_at), words)
    silent = pc.equal(pc.list_value_length(word_ids), 0)
    yield _rows("srl_arg", pc.filter(arg_sid, silent), pc.filter(arg_item, silent), pc.filter(arg_no, silent), None)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for out in link_rows(b):
            if len(out):
                yield out


def flatten_links(sxml: DataFrame) -> DataFrame:
    """One row per sentence, MP and WSD entry, SRL entry and word of an SRL argument of every file's newest readable delivery.

    Columns as FOUND_SCHEMA. A lone object counts as an array of one; null and absent layers as empty; a null item of a layer keeps its
    place and names no word; what stands in a sentence's place without being an object is none. Word ids are text, '' where absent;
    several ids of one MP or WSD entry are joined by '|'; an argument that names a word twice gives it once. Damaged, null and
    repeated deliveries give nothing; an empty table gives no rows.
    """
    return typed_documents(newest_readable(sxml), ("mp", "wsd", "srl")).mapInArrow(_links, FOUND_SCHEMA)


#: Layer to the fields of its table, after the keys and item_no.
ENTRY_FIELDS = {"word": ("id", "form"), "mp": ("word_id", "form", "label"), "wsd": ("word_id", "form", "pos", "sense_id"), "dp": ("word_id", "word_form", "head", "label"), "srl": ("word_id", "form", "lemma", "sense_id")}
_ZA = ("arg_no", "form", "word_id", "restored_form", "restored_type", "antecedent_form", "antecedent_sentence_id")
ENTRY_SCHEMAS = {k: f"{KEYS}, item_no int, " + ", ".join(f"{f} string" for f in fs) for k, fs in ENTRY_FIELDS.items()}
ENTRY_SCHEMAS["za"] = f"{KEYS}, item_no int, arg_no int, " + ", ".join(f"{f} string" for f in _ZA[1:])


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _table(documents: DataFrame, schema: str, make) -> DataFrame:
    """A flat table: ``make`` gives the columns of a batch's sentences."""
    names = _names(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = make(Sentences(b))
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(rows, schema)


def flatten_sentences(documents: DataFrame) -> DataFrame:
    """The index of sentences of `typed_documents`: keys, form, speaker_id."""
    return _table(documents, f"{KEYS}, form string, speaker_id string", lambda s: [*s.keys, s.field("form"), s.field("speaker_id")])


def flatten_layer(documents: DataFrame, layer: str) -> DataFrame:
    """The full flat table of one layer (word, mp, wsd, dp, srl, za) of `typed_documents`: keys, position and all fields. An SRL entry
    shows its predicate; za has one row per restored part with its predicate and the first antecedent. Several word ids are joined
    by '|', of a predicate the first counts; absent fields are null, absent word ids ''."""

    def entries(s: Sentences) -> list[pa.Array]:
        at, no, values = children(s.field(layer))
        source = pc.struct_field(values, "predicate") if layer == "srl" else values
        ids = first_id if layer == "srl" else id_text
        own = [ids(pc.struct_field(source, f)) if f == "word_id" else pc.struct_field(source, f) for f in ENTRY_FIELDS[layer]]
        return [*s.keys_at(at), pc.cast(no, pa.int32()), *own]

    def restored(s: Sentences) -> list[pa.Array]:
        at, no, values = children(s.field("za"))
        part_at, part_no, parts = children(pc.struct_field(values, "parts"))
        pred = pc.take(pc.struct_field(values, "predicate"), part_at)
        part = lambda f, g: pc.struct_field(pc.struct_field(parts, f), g)
        own = [pc.struct_field(pred, "form"), first_id(pc.struct_field(pred, "word_id")), part("restored", "form"), part("restored", "type"), part("antecedent", "form"), part("antecedent", "sentence_id")]
        return [*s.keys_at(pc.take(at, part_at)), pc.cast(pc.take(no, part_at), pa.int32()), pc.cast(part_no, pa.int32()), *own]

    return _table(documents, ENTRY_SCHEMAS[layer], restored if layer == "za" else entries)


def flatten_arguments(documents: DataFrame) -> DataFrame:
    """SRL arguments and adjuncts with their fields and word ids (joined by '|'), linked to the sentence, the SRL entry and its predicate."""

    def arguments(s: Sentences) -> list[pa.Array]:
        at, no, frames = children(s.field("srl"))
        arg_at, arg_no, args = children(pc.struct_field(frames, "args"))
        pred = pc.take(pc.struct_field(frames, "predicate"), arg_at)
        own = [pc.struct_field(args, f) for f in ("role", "form", "label")]
        predicate = [first_id(pc.struct_field(pred, "word_id")), pc.struct_field(pred, "lemma"), pc.struct_field(pred, "sense_id")]
        return [*s.keys_at(pc.take(at, arg_at)), pc.cast(pc.take(no, arg_at), pa.int32()), pc.cast(arg_no, pa.int32()), *own, id_text(pc.struct_field(args, "word_id")), *predicate]

    schema = f"{KEYS}, item_no int, arg_no int, role string, form string, label string, word_ids string, predicate_word_id string, predicate_lemma string, predicate_sense_id string"
    return _table(documents, schema, arguments)


def flatten_analyses(documents: DataFrame) -> DataFrame:
    """(keys, word_surface, morpheme_analysis): each word with the MP entries that name it, ``form/label`` joined by ``+`` in their order; ''
    for a word that none names. Words and entries of a batch are grouped and met as Arrow tables."""

    def analyses(s: Sentences) -> list[pa.Array]:
        w_at, w_no, words = children(s.field("word"))
        m_at, m_no, entries = children(s.field("mp"))
        text = pc.binary_join_element_wise(pc.struct_field(entries, "form"), pc.struct_field(entries, "label"), "/")
        mp = pa.table({"s": m_at, "id": pc.struct_field(entries, "word_id"), "t": text})
        mp = mp.filter(pc.and_(pc.is_valid(mp["t"]), pc.is_valid(mp["id"])))
        per = mp.group_by(["s", "id"], use_threads=False).aggregate([("t", "list")]).combine_chunks()
        joined_t = pa.array([], pa.string()) if not len(per) else pc.binary_join(per["t_list"].chunk(0), "+")
        per = pa.table({"s": per["s"], "id": per["id"], "t": joined_t})
        own = pa.table({"s": w_at, "id": pc.fill_null(pc.struct_field(words, "id"), "\0"), "row": pa.array(np.arange(len(w_at), dtype=np.int64)), "form": pc.struct_field(words, "form")})
        joined = own.join(per, ["s", "id"], join_type="left outer", use_threads=False).sort_by("row").combine_chunks()
        one = lambda c: joined[c].combine_chunks() if len(joined) else pa.array([], pa.string())
        return [*s.keys_at(w_at), one("form"), pc.fill_null(one("t"), "")]

    return _table(documents, f"{KEYS}, word_surface string, morpheme_analysis string", analyses)
