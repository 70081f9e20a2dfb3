"""The frame trace as a wide table and as CSV lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, csv_flag, csv_number
from ..operators.joins import covering_block
from .diarization import KEYS, Result

#: The trace's columns in order, and how each is written.
TRACE = {
    "start_seconds": "number",
    "end_seconds": "number",
    "speaker": "text",
    "acoustic_speaker": "text",
    "temporal_adjusted": "flag",
    "speaker_acoustic_confidence": "number",
    "speaker_reliability": "number",
    "speaker_evidence_strength": "number",
    "speaker_resolved_confidence": "number",
    "raw_rms": "number",
    "enhanced_rms": "number",
    "enhancement_gain_db": "number",
    "pitch_hz": "number",
    "pitch_confidence": "number",
    "voiced_probability": "number",
    "centroid_hz": "number",
    "flatness": "number",
    "consistency": "number",
    "transient_likelihood": "number",
    "noise_likelihood": "number",
    "noise_low_energy": "number",
    "noise_flatness": "number",
    "noise_stationarity": "number",
    "noise_pitch_unreliability": "number",
    "noise_transient": "number",
    "raw_quality": "number",
    "enhanced_quality": "number",
    "view_agreement": "number",
}


def csv_line(columns: dict[str, str]):
    """A row's fields by kind (number, flag, text), comma-joined."""
    write = {"number": csv_number, "flag": csv_flag, "text": csv_field}
    return F.concat_ws(",", *[write[kind](c) for c, kind in columns.items()])


def trace_rows(result: Result, blocks: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per raw frame with everything known about it.

    A frame of several observations has what the last of them says.
    ``blocks`` (keys, start_s, end_s, gain_db) are enhancement blocks.
    """
    obs, a = result.observations, result.assignments
    last = lambda c: F.max_by(c, "obs_id").alias(c)
    members = obs.select(*keys, "obs_id", F.explode("frame_ids").alias("id"), F.col("agreement.combined").alias("view_agreement"))
    told = a.select(*keys, "obs_id", F.col("speaker").alias("acoustic_speaker"), F.col("changed_by_continuity").alias("temporal_adjusted"), F.col("confidence").alias("speaker_acoustic_confidence"), F.col("reliability").alias("speaker_reliability"), F.col("evidence_strength").alias("speaker_evidence_strength"), F.col("resolved_confidence").alias("speaker_resolved_confidence"))
    owner = result.segments.select(*keys, F.col("speaker"), F.explode("observation_ids").alias("obs_id"))
    told = members.join(told, [*keys, "obs_id"], "left").join(owner, [*keys, "obs_id"], "left")
    names = [c for c in told.columns if c not in (*keys, "obs_id", "id")]
    per_frame = told.groupBy(*keys, "id").agg(*[last(c) for c in names])
    f = result.evidence if result.evidence is not None else result.frames
    rows = f.join(per_frame, [*keys, "id"], "left")
    if result.enhanced is not None:
        rows = rows.join(result.enhanced.select(*keys, "id", F.col("rms").alias("enhanced_rms"), F.col("quality_score").alias("enhanced_quality")), [*keys, "id"], "left")
    if blocks is not None:
        rows = covering_block(rows, blocks.select(*keys, F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"), "gain_db"), keys, "start_s", ("b_start", "b_end"), "gain_db", "enhancement_gain_db")
    given = {"start_seconds": "start_s", "end_seconds": "end_s", "raw_rms": "rms", "pitch_confidence": "pitch_conf", "voiced_probability": "voiced_prob", "transient_likelihood": "transient", "raw_quality": "quality_score", "noise_flatness": "noise_flatness_evidence", "noise_stationarity": "noise_stationarity_evidence"}
    have = set(rows.columns)
    pick = lambda n: F.col(given.get(n, n)) if given.get(n, n) in have else F.lit(None).cast("string" if TRACE[n] == "text" else "double")
    out = [F.coalesce(F.col("temporal_adjusted"), F.lit(False)).alias(n) if n == "temporal_adjusted" else pick(n).alias(n) for n in TRACE]
    return rows.select(*keys, "id", *out)


def trace_csv(result: Result, blocks: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, line_no, line): the header as line 0 of each session, then one line per frame; each ends with a line feed when written."""
    rows = trace_rows(result, blocks, keys)
    lines = rows.select(*keys, (F.col("id") + 1).alias("line_no"), csv_line(TRACE).alias("line"))
    header = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("line_no"), F.lit(",".join(TRACE)).alias("line"))
    return header.unionByName(lines)


def write_trace(result: Result, path: str, blocks: DataFrame | None = None, keys: Sequence[str] = KEYS) -> None:
    """Text files of CSV lines in order, one folder per session."""
    lines = trace_csv(result, blocks, keys)
    lines.repartition(*keys).sortWithinPartitions(*keys, "line_no").drop("line_no").write.partitionBy(*keys).text(path)
