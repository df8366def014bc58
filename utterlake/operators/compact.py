"""Consolidation of very many small files into few well-sized ones, without losing or doubling a record."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from utterlake.session import new_path, stored

#: Bytes of source files per bin and per writing task, and the bounds of one packing task.
TARGET_BYTES, TASK_BYTES, SHARD_BYTES, SHARD_FILES = 64 << 20, 512 << 20, 256 << 30, 100_000
RECORD_SCHEMA = "layer string, utt_id string, path string, modified_at timestamp, payload string"

csv.field_size_limit(1 << 30)
_COPY = re.compile(r"(?: ?\(\d+\)| ?- ?[Cc]opy(?: ?\(\d+\))?)$")
_TIERS = re.compile(r"^[ \t]*size[ \t]*=[ \t]*(\d+)[ \t]*$", re.M)
_ITEM = re.compile(r"^[ \t]*item[ \t]*\[\d+\][ \t]*:?[ \t]*$", re.M)
_ANNOUNCED = re.compile(r"^[ \t]*(?:intervals|points)[ \t]*:[ \t]*size[ \t]*=[ \t]*(\d+)[ \t]*$", re.M)
_INTERVAL = re.compile(
    r'^[ \t]*(?:intervals|points)[ \t]*\[\d+\][ \t]*:?[ \t]*\n[ \t]*(?:xmin[ \t]*=[ \t]*[-\d.eE]+[ \t]*\n[ \t]*xmax|number|time)[ \t]*=[ \t]*[-\d.eE]+[ \t]*\n[ \t]*(?:text|mark)[ \t]*=[ \t]*"(?:[^"]|"")*"[ \t]*$',
    re.M,
)


def data_files(files: DataFrame) -> DataFrame:
    """The files that hold data of a layer, by their names: adds ``layer``; side files (``_``, ``.``) and other extensions leave."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    layer = F.when(ext == "csv", "search_master").when(ext == "textgrid", "textgrid_eojeol")
    return files.select("path", "size_bytes", "modified_at", "content").withColumn("layer", layer).where(layer.isNotNull() & ~name.rlike(r"^[_.]"))


def textgrid_complete(text: str) -> bool:
    """Whether all tiers and intervals that a long TextGrid announces are there to the end."""
    if "ooTextFile" not in text[:200] or "TextGrid" not in text[:400]:
        return False
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    tiers = _TIERS.search(text)
    if not tiers:
        return False
    announced = [int(x) for x in _ANNOUNCED.findall(text)]
    return len(_ITEM.findall(text)) == int(tiers[1]) == len(announced) and len(_INTERVAL.findall(text)) == sum(announced)


def csv_records(text: str) -> Iterator[tuple[str, str]]:
    """(utt_id, record as JSON) of the complete records of a CSV file: those with all fields of its header and no NUL (a file broken off may be padded with them)."""
    rows = csv.reader(io.StringIO(text.lstrip("﻿"), newline=""))
    try:
        header = [h.strip().strip("﻿") for h in next(rows)]
        if "utt_id" not in header:
            return
        at = header.index("utt_id")
        for row in rows:
            if len(row) == len(header) and row[at].strip() and not any("\0" in x for x in row):
                yield row[at].strip(), json.dumps(dict(zip(header, row, strict=True)), ensure_ascii=False)
    except (StopIteration, csv.Error):
        return


def textgrid_utterance(path: str) -> str:
    """The utterance in a TextGrid's name, less a copy mark."""
    return _COPY.sub("", path.rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("layer", pa.string()), ("utt_id", pa.string()), ("path", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("payload", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        rows: list[tuple] = []
        for layer, path, at, text in zip(*(b.column(c) for c in ("layer", "path", "modified_at", "content")), strict=True):
            layer, path, at, text = layer.as_py(), path.as_py(), at.value, text.as_py()
            if text is None:
                continue
            if layer == "textgrid_eojeol":
                if textgrid_complete(text) and (utt := textgrid_utterance(path)):
                    rows.append((layer, utt, path, at, text))
            else:
                rows.extend((layer, utt, path, at, payload) for utt, payload in csv_records(text))
            if len(rows) >= 4000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def records(files: DataFrame) -> DataFrame:
    """One row per complete record of `data_files`."""
    f = files.select("layer", "path", F.col("modified_at").cast("timestamp").alias("modified_at"), "content").where("content is not null and content <> ''")
    return f.mapInArrow(_records, RECORD_SCHEMA)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size. Free room stands in a tournament tree, so the first bin with room is found in log time; what is larger than the capacity has a bin of its own."""
    order = np.argsort(-sizes, kind="stable")
    n = 1 << max(1, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * n)
    out = np.empty(len(sizes), dtype=np.int64)
    for i in order.tolist():
        need = min(int(sizes[i]), capacity)
        node = 1
        while node < n:
            node = 2 * node + (room[2 * node] < need)
        out[i] = node - n
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return out


def pack_manifest(manifest: DataFrame, target_bytes: int = TARGET_BYTES, shard_bytes: int = SHARD_BYTES, shard_files: int = SHARD_FILES) -> DataFrame:
    """(path, bin): first-fit decreasing over the manifest (path, size_bytes).

    A very large manifest is cut by hash into shards of bounded size that are packed apart; each costs at most one bin that isn't full. A path
    that is listed more than once is packed once, by its greatest size; null and negative sizes count as 0.
    """
    one = manifest.where("path is not null").groupBy("path").agg(F.greatest(F.max(F.coalesce("size_bytes", F.lit(0))), F.lit(0)).alias("size_bytes"))
    n, total = one.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    shards = max(1, -(-int(total) // shard_bytes), -(-int(n) // shard_files))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size_bytes", "path"], ascending=[False, True])
        bins = first_fit_decreasing(pdf["size_bytes"].to_numpy(), target_bytes)
        return pd.DataFrame({"path": pdf["path"], "bin": [f"{s:05d}-{b:05d}" for s, b in zip(pdf["shard"], bins, strict=True)]})

    return one.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(pack, "path string, bin string")


def newest_records(recs: DataFrame) -> DataFrame:
    """Each utterance of a layer once, from the file with the newest modified_at that holds it complete; ties go to the greater path."""
    kept = F.max_by(F.struct("path", "payload"), F.struct(F.coalesce("modified_at", F.lit("0001-01-01").cast("timestamp")), F.col("path"), F.col("payload"))).alias("r")
    return recs.groupBy("layer", "utt_id").agg(kept).select("layer", "utt_id", "r.path", "r.payload")


def _checks(df: DataFrame) -> list:
    """Row count, and a checksum that doesn't hang on the order."""
    return [F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("layer", "utt_id", "path", "payload")), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.xxhash64("layer", "utt_id", "path", "payload").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class _BinWriter:
    """Writes the records of one bin after another, each bin to files of its own under a folder of any file system that Arrow knows.

    Files are named by the attempt, so a task that runs twice leaves files that nothing names. A bin whose file has grown to the
    target goes on in a further file.
    """

    def __init__(self, folder: str, target_bytes: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.target, self.done, self.writer, self.bin = target_bytes, [], None, None

    def write(self, bin_: str, rows: pa.RecordBatch) -> None:
        if self.writer is not None and (bin_ != self.bin or self.sink.tell() >= self.target):
            self.close()
        if self.writer is None:
            self.bin, self.name, self.rows = bin_, f"{bin_}-{uuid.uuid4().hex}.parquet", 0
            self.sink = self.fs.open_output_stream(f"{self.path}/{self.name}")
            self.writer = pq.ParquetWriter(self.sink, rows.schema, compression="zstd")
        self.writer.write_batch(rows)
        self.rows += rows.num_rows

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            size = self.sink.tell()
            self.sink.close()
            self.done.append((self.bin, self.name, self.rows, size))
            self.writer = None


FILES_SCHEMA = "bin string, file string, records bigint, bytes bigint"


def _write_bins(folder: str, target_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _BinWriter(folder, target_bytes)
        for b in batches:
            bins = b.column("bin").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(bins[1:] != bins[:-1]) + 1).tolist(), len(bins)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    out.write(bins[i], b.slice(i, j - i))
        out.close()
        if out.done:
            types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.done, strict=True), types, strict=True)], names=["bin", "file", "records", "bytes"])

    return run


def consolidate(files: DataFrame, target: str, target_bytes: int = TARGET_BYTES, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rewrite all complete records of the listed small files into one file per bin under ``target``: (the records, the files with their
    bin, records and bytes as written).

    The manifest and its bins are written down first, so the plan stays the same however long the job runs. Records are parsed once;
    copies in other files fall to the newest before they are moved to their bin. A task writes many bins, sorted, one after the
    other; files lie in one folder. A task that fails leaves files that aren't named by what the job returns; they are removed. What
    the writers were given and what stands in the named files must agree in count and checksums; only then one rename makes the
    folder visible. A target that exists is an error. Empty, broken and foreign files give no records; an empty table gives an empty folder.
    """
    spark = files.sparkSession
    listed = data_files(files)
    plan = stored(pack_manifest(listed, target_bytes), "manifest")
    total = listed.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    tasks = max(1, -(-int(total) // task_bytes), min(spark.sparkContext.defaultParallelism, plan.agg(F.count_distinct("bin")).first()[0]))
    kept = newest_records(records(listed)).join(plan, "path").select("layer", "utt_id", "path", "payload", "bin")
    seen, staging = Observation("handed to the writers"), f"{target}.staging"
    fs, folder = _fs(spark, staging)
    fs.delete(folder, True)
    fs.mkdirs(folder)
    placed = kept.repartition(tasks, "bin").sortWithinPartitions("bin", "layer", "utt_id")
    written = placed.observe(seen, *_checks(placed)).mapInArrow(_write_bins(_arrow_uri(staging), target_bytes), FILES_SCHEMA)
    named = stored(written, "files")
    got = _read_back(spark, staging, named).agg(*_checks(placed)).first().asDict()
    if got != {**dict.fromkeys(got), **seen.get}:
        raise RuntimeError(f"{staging} isn't what was written: {got} instead of {seen.get}")
    for name in _unnamed(spark, fs, folder, named):
        fs.delete(_fs(spark, f"{staging}/{name}")[1], False)
    to = _fs(spark, target)[1]
    if fs.exists(to) or not fs.rename(folder, to):
        raise RuntimeError(f"{target} can't be committed")
    return _read_back(spark, target, named), named


def _arrow_uri(path: str) -> str:
    """Hadoop writes ``file:/x``, Arrow ``file:///x``."""
    return re.sub(r"^file:/+", "file:///", path)


def _read_back(spark: SparkSession, folder: str, named: DataFrame) -> DataFrame:
    """The records of the named files. Others, left by attempts that failed, may lie beside them until they are removed."""
    schema = "layer string, utt_id string, path string, payload string, bin string"
    df = spark.read.schema(schema).parquet(folder)
    own = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.withColumn("file", own).join(named.select("file"), "file", "left_semi").drop("file")


def _unnamed(spark: SparkSession, fs, folder, named: DataFrame) -> list[str]:
    """Files of the folder that no task returned: only where there are more files than names are both compared."""
    n = named.count()
    listed = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")]
    if len(listed) == n:
        return []
    return [r.file for r in spark.createDataFrame([(x,) for x in listed], "file string").join(named.select("file"), "file", "left_anti").collect()]


def consolidated(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The records of `consolidate` into a new folder of the session's shared folder."""
    return consolidate(files, new_path(files.sparkSession, "consolidated"), target_bytes)[0]


def file_report(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Bin, records and bytes of each file that `consolidate` writes, and its size as a share of the target."""
    named = consolidate(files, new_path(files.sparkSession, "consolidated"), target_bytes)[1]
    return named.select("bin", "records", "bytes", (F.col("bytes") / target_bytes).alias("filled"))


def bin_report(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Files and bytes of each bin of the packed manifest."""
    listed = data_files(files).select("path", "size_bytes")
    sizes = listed.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))
    return pack_manifest(listed, target_bytes).join(sizes, "path").groupBy("bin").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
