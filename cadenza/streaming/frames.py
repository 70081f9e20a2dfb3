"""Frames of a chunk stream: the accumulator as grouped state.

Each session keeps what the next frames need (pending samples, their start, the
expected next start, a batch counter); a row with ``is_last`` ends a session.
Noise floor, class and quality are those of a batch of frames, as the stream
cannot know the rest; a one-shot run uses the whole session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import AcousticConfig
from ..operators.dsp import FRAME_SCHEMA, Accumulator
from ..operators.frames import classified, with_consistency
from ..operators.ordered import rebased
from ..session import shared_folder

STATE = "rate int, pending binary, pending_start double, implicit_start double, batch_no long, finished boolean"


def _load(state: GroupState, config: AcousticConfig, batch_seconds: float) -> Accumulator:
    acc = Accumulator(config, batch_seconds)
    if state.exists:
        rate, pending, start, implicit, number, done = state.get
        acc.rate, acc.pending, acc.pending_start, acc.implicit_start, acc.batch_no, acc.finished = rate, np.frombuffer(pending, np.float32), start, implicit, number, done
    return acc


def frame_stream(chunks: DataFrame, config: AcousticConfig = AcousticConfig(), batch_seconds: float = 4.0) -> DataFrame:
    """Feature rows (FRAME_SCHEMA) of a stream of (session_id, chunk_index, start_s, sample_rate, samples, is_last)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acc = _load(state, config, batch_seconds)
        rows = pd.concat(list(batches)).sort_values("chunk_index", kind="stable")
        out: list[pa.RecordBatch] = []
        for r in rows.itertuples(index=False):
            start = None if pd.isna(r.start_s) else float(r.start_s)
            if r.samples is not None and len(r.samples):
                out += acc.consume(key[0], int(r.sample_rate), np.asarray(r.samples, np.float32), start)
            if r.is_last:
                out += acc.finish(key[0])
        state.update((acc.rate, acc.pending.astype(np.float32).tobytes(), acc.pending_start, acc.implicit_start, acc.batch_no, acc.finished))
        yield from (b.to_pandas() for b in out)

    rows = chunks.select("session_id", "chunk_index", "start_s", "sample_rate", "samples", "is_last")
    return rows.groupBy("session_id").applyInPandasWithState(run, FRAME_SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def streamed_frames(chunks: DataFrame, config: AcousticConfig = AcousticConfig(), batch_seconds: float = 4.0) -> DataFrame:
    """Writes a chunk table (with is_last) to files, streams over them until all are read, and returns the frames written."""
    spark = chunks.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{base}/in")
    stream = frame_stream(spark.readStream.schema(chunks.schema).parquet(f"{base}/in"), config, batch_seconds)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(FRAME_SCHEMA).parquet(f"{base}/out")


def twin_streams(chunks: DataFrame, enhance: Callable[[DataFrame], DataFrame], config: AcousticConfig = AcousticConfig(), batch_seconds: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """The raw and the enhanced view of one chunk stream; both see the same chunks, so their frames have the same grid."""
    return frame_stream(chunks, config, batch_seconds), frame_stream(enhance(chunks), config, batch_seconds)


def assembled(frames: DataFrame, config: AcousticConfig = AcousticConfig()) -> DataFrame:
    """Classified frames of what a stream (or a batch run) has written.

    Floor, class and quality by batch; ids from 0 by start; consistency across
    batches as if there were none.
    """
    rows = classified(frames, ["session_id", "batch_no"], config)
    rows = rebased(rows, ["session_id"], ["start_s", "batch_no"], "id")
    return with_consistency(rows, ["session_id"], ["id"], "sample_rate")


def one_shot(frames: DataFrame, config: AcousticConfig = AcousticConfig()) -> DataFrame:
    """Classified frames with floor, class and quality of the whole session."""
    rows = classified(frames, ["session_id"], config)
    rows = rebased(rows, ["session_id"], ["start_s", "batch_no"], "id")
    return with_consistency(rows, ["session_id"], ["id"], "sample_rate")
