"""Audio as bytes: headers of plain PCM, lengths by walking the chunks of a WAV, sessions from the clips of their utterances."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the corpus' audio: samples a second, bytes a sample, channels.
RATE, WIDTH, CHANNELS = 16_000, 2, 1


def _turned(hexed: Column, n: int) -> Column:
    """The hexadecimal digits of n bytes in the opposite order of bytes."""
    return F.concat(*[F.substring(hexed, 2 * i - 1, 2) for i in range(n, 0, -1)])


def _little(c: Column, n: int) -> Column:
    """A number as n bytes, the lowest first."""
    return F.unhex(_turned(F.lpad(F.hex(c.cast("bigint")), 2 * n, "0"), n))


def _number(content: Column, at: int, n: int = 4) -> Column:
    """The number that n bytes from position ``at`` (from 1) write, the lowest first."""
    return F.conv(_turned(F.hex(F.substring(content, at, n)), n), 16, 10).cast("double")


def wav_header(data_bytes: Column, rate: int = RATE, width: int = WIDTH, channels: int = CHANNELS) -> Column:
    """The 44 bytes before so many bytes of PCM; null for null."""
    frame = width * channels
    parts = [F.encode(F.lit("RIFF"), "UTF-8"), _little(data_bytes + 36, 4), F.encode(F.lit("WAVEfmt "), "UTF-8"), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(channels), 2)]
    parts += [_little(F.lit(rate), 4), _little(F.lit(rate * frame), 4), _little(F.lit(frame), 2), _little(F.lit(8 * width), 2), F.encode(F.lit("data"), "UTF-8"), _little(data_bytes, 4)]
    return F.concat(*parts)


def header_seconds(header: Column) -> Column:
    """Seconds by a header of 44 bytes: data bytes over bytes a second."""
    return F.try_divide(_number(header, 41), _number(header, 29))


def chunk_seconds(content: bytes) -> float | None:
    """Seconds of a WAV whatever chunks stand before its data; null for what isn't one. A data chunk that is broken off counts as far
    as it goes."""
    if content is None or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, per_second = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 20 <= len(content):
            per_second = int.from_bytes(content[at + 16 : at + 20], "little")
        elif name == b"data":
            return min(size, len(content) - at - 8) / per_second if per_second else None
        at += 8 + size + size % 2
    return None


@F.arrow_udf(T.DoubleType())
def wav_seconds(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`chunk_seconds` of a column of files."""
    for x in contents:
        yield pa.array([chunk_seconds(c) for c in x.to_pylist()], pa.float64())


def session_audio(clips: DataFrame, gap_seconds: float = 0.0) -> DataFrame:
    """clips (session_id, num, pcm, rate) to one WAV per session whose clips all have one rate: session_id, wav, seconds; others are left
    out, as are clips without content. The bytes of a session meet in one row, so this is for chosen sessions, not for a corpus."""
    good = clips.where(F.length("pcm") > 0)
    silence = F.expr(f"unhex(repeat('00', {2 * round(gap_seconds * RATE)}))")
    g = good.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("num", "pcm"))).alias("c"), F.min("rate").alias("lo"), F.max("rate").alias("hi")).where("lo = hi")
    joined = F.aggregate("c", F.lit(None).cast("binary"), lambda acc, x: F.when(acc.isNull(), x["pcm"]).otherwise(F.concat(acc, silence, x["pcm"])))
    g = g.withColumn("pcm", joined)
    return g.select("session_id", F.concat(wav_header(F.length("pcm")), "pcm").alias("wav"), (F.length("pcm") / (RATE * WIDTH * CHANNELS)).alias("seconds"))
