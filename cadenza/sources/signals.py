"""Sample tables: synthetic signals and WAV files as chunk rows.

A chunk row is (session_id, chunk_index, start_s, sample_rate, samples).
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNKS = "session_id string, chunk_index long, start_s double, sample_rate int, samples array<float>"


def silence(seconds: float, rate: int = 16000) -> np.ndarray:
    return np.zeros(int(seconds * rate), np.float32)


def sine(hertz: float, seconds: float, amplitude: float = 0.25, rate: int = 16000) -> np.ndarray:
    i = np.arange(int(seconds * rate))
    return (np.float32(amplitude) * np.sin(2 * np.pi * hertz * i / rate).astype(np.float32)).astype(np.float32)


def alternating(seconds: float, amplitude: float = 0.25, rate: int = 16000) -> np.ndarray:
    n = int(seconds * rate)
    return np.where(np.arange(n) % 2 == 0, amplitude, -amplitude).astype(np.float32)


def chunk_rows(session: str, samples: np.ndarray, rate: int = 16000, chunk_seconds: float = 1.0, start: float = 0.0) -> list[tuple]:
    n = max(1, int(chunk_seconds * rate))
    return [(session, k, start + i / rate, rate, samples[i : i + n].tolist()) for k, i in enumerate(range(0, len(samples), n))]


def chunk_table(spark: SparkSession, sessions: dict[str, np.ndarray], rate: int = 16000, chunk_seconds: float = 1.0) -> DataFrame:
    rows = [r for s, x in sessions.items() for r in chunk_rows(s, x, rate, chunk_seconds)]
    return spark.createDataFrame(rows, CHUNKS)


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1] of a PCM WAV file (8, 16, 24 or 32 bit)."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(2 ** (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(1).astype(np.float32)


def read_wav(spark: SparkSession, path: str, chunk_seconds: float = 4.0) -> DataFrame:
    """Chunk rows of all WAV files under a path; a file's path is its session. Files are read and decoded in the executors."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rate, x = decode_wav(bytes(content))
                yield pd.DataFrame(chunk_rows(name, x, rate, chunk_seconds), columns=["session_id", "chunk_index", "start_s", "sample_rate", "samples"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(decode, CHUNKS)


def resolved_starts(chunks: DataFrame, keys: Sequence[str], order: str = "chunk_index", candidates: Sequence[str] = ("range_start_s", "presentation_s", "host_s")) -> DataFrame:
    """Adds start_s: the first known of the candidates, else the end of the chunk before, else 0."""
    known = F.coalesce(*[F.col(c).cast("double") for c in candidates])
    length = F.col("n_samples") / F.col("sample_rate")
    w = Window.partitionBy(*keys).orderBy(order)
    # Chunks without a time follow the last known one: its start plus all lengths since.
    anchor = F.last(F.when(known.isNotNull(), F.col("_before")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.withColumn("_before", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.withColumn("start_s", F.coalesce(at, F.lit(0.0)) + F.col("_before") - F.coalesce(anchor, F.lit(0.0))).drop("_before")


def sample_range(start: str, end: str, audio_start: str, rate: str, n_samples: str):
    """struct<first, past> of the samples a time window covers (floor and ceiling, clipped), or null if none."""
    s, e, a, r, n = (F.col(c).cast("double") for c in (start, end, audio_start, rate, n_samples))
    lo, hi = F.greatest(F.lit(0.0), s - a), F.least(n / r, e - a)
    first = F.greatest(F.lit(0.0), F.least(n, F.floor(lo * r).cast("double")))
    past = F.greatest(first, F.least(n, F.ceil(hi * r).cast("double")))
    good = (r > 0) & (n > 0) & (e > s) & (hi > lo) & (past > first)
    return F.when(good, F.struct(first.cast("long").alias("first"), past.cast("long").alias("past")))


def session_buffers(chunks: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "chunk_index") -> DataFrame:
    """One row per session: start of its first chunk and all samples in order; for recordings that fit a task."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("start_s").alias("s"), F.col("samples").alias("x"))))
    return chunks.groupBy(*keys).agg(F.first("sample_rate").alias("sample_rate"), rows.alias("r")).select(*keys, "sample_rate", F.element_at("r", 1)["s"].alias("start_s"), F.flatten(F.transform("r", lambda z: z["x"])).alias("samples"))
