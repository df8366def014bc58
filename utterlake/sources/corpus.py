"""Readers and writers of the corpus layers as files: nested JSON, session CSV, audio inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPEAKER = "id string, age string, sex string, occupation string, birthplace string, principal_residence string, current_residence string, education string"
DIALOGUE = (
    "id string, metadata struct<title:string,category:string>, document array<struct<id:string,"
    "metadata:struct<topic:string,date:string,setting:struct<relation:string>,speaker:array<struct<" + _SPEAKER.replace(" string", ":string").replace(", ", ",") + ">>>,"
    "utterance:array<struct<id:string,speaker_id:string,form:string,original_form:string,start:string,end:string,note:string>>>>, _corrupt_record string"
)


def read_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file; a file that can't be parsed has its text in ``_corrupt_record`` and fails nothing. Scalars are read as text."""
    r = spark.read.schema(DIALOGUE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("primitivesAsString", True)
    return r.json(folder).withColumn("path", F.col("_metadata.file_path"))


def _documents(files: DataFrame) -> DataFrame:
    return files.where("_corrupt_record is null").select("path", F.col("id").alias("file_id"), "metadata", F.posexplode("document").alias("doc_pos", "d"))


def dialogue_utterances(files: DataFrame) -> DataFrame:
    """Utterances in file order; blank forms are dropped, texts stripped."""
    u = _documents(files).select("file_id", F.col("d.id").alias("doc_id"), "doc_pos", F.posexplode("d.utterance").alias("pos", "u"))
    form = F.trim(F.coalesce("u.form", F.lit("")))
    return u.select("file_id", "doc_id", "doc_pos", "pos", F.col("u.id").alias("utt_id"), F.coalesce("u.speaker_id", F.lit("")).alias("speaker_id"), form.alias("form"), "u.original_form", "u.start", F.col("u.end").alias("end_sec"), "u.note").where("form <> ''")


def dialogue_speakers(files: DataFrame) -> DataFrame:
    """Speakers, the first occurrence of an id by path and position."""
    s = _documents(files).select("path", "doc_pos", F.posexplode("d.metadata.speaker").alias("pos", "s")).select("path", "doc_pos", "pos", "s.*").where("id is not null")
    rest = [c for c in s.columns if c not in ("path", "doc_pos", "pos", "id")]
    return s.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("path", "doc_pos", "pos")).alias("r")).select("id", "r.*")


def dialogue_metadata(files: DataFrame) -> DataFrame:
    """One row per document."""
    d = _documents(files)
    return d.select("file_id", F.col("d.id").alias("doc_id"), F.trim(F.coalesce("metadata.category", F.lit(""))).alias("category"), F.trim(F.coalesce("d.metadata.topic", F.lit(""))).alias("topic"), F.trim(F.coalesce("d.metadata.date", F.lit(""))).alias("date"), F.trim(F.coalesce("d.metadata.setting.relation", F.lit(""))).alias("relation"), F.size(F.coalesce("d.metadata.speaker", F.array())).alias("n_speakers"), F.array_join(F.transform("d.metadata.speaker", lambda s: s["id"]), "|").alias("speaker_ids"))


def read_sessions(spark: SparkSession, folder: str, schema: str, sessions: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Session CSVs (BOM, quoted line breaks) with year and session from their paths; side files are never data. Optionally some sessions, or the first n by name."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*.csv").csv(folder)
    df = df.withColumn("_stem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)).withColumn("year", F.regexp_extract(F.col("_metadata.file_path"), r"(?:^|/)(20\d\d)", 1))
    if sessions is not None:
        df = df.where(F.col("_stem").isin(sessions))
    if first is not None:
        df = df.join(F.broadcast(df.select("_stem").distinct().orderBy("_stem").limit(first)), "_stem", "left_semi")
    return df.withColumnRenamed("_stem", "session")


def write_sessions(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """One folder per year, sorted by session inside; Spark's committer makes the files visible together. The number of files follows the
    size of the data: adaptive execution cuts a large year into several tasks and joins small ones."""
    df.hint("rebalance", "year").sortWithinPartitions("year", "session_id").write.mode("overwrite").partitionBy("year").format(fmt).option("header", True).save(folder)


def append_new(df: DataFrame, folder: str, key: str) -> None:
    """Append rows whose key isn't there yet."""
    spark = df.sparkSession
    old = spark.read.parquet(folder).select(key)
    df.join(old, key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(folder)


def file_inventory(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, stem, length, modified): a listing as a table; contents are pruned and never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("stem"), "length", F.col("modificationTime").alias("modified"))


def pcm_seconds(length: Column, rate: int = 16_000, width: int = 2) -> Column:
    return length / float(rate * width)


def is_broken_wav(length: Column) -> Column:
    """Shorter than a WAV header."""
    return length < 44
