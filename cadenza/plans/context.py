"""Nested context of a session, at three levels of detail, and report lines."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AlignmentConfig
from ..functions.distribution import distribution
from ..functions.text import decimals, optional_decimals
from ..operators.segments import acoustic_profiles, embedding_profiles
from .diarization import KEYS, Result

LEVELS = ("conversation", "diagnostic", "complete")


def time_range(start: str = "start_s", end: str = "end_s") -> Column:
    s, e = F.col(start), F.col(end)
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("startSeconds"), e.alias("endSeconds"), (e - s).alias("durationSeconds")))


def _listed(df: DataFrame, keys: Sequence[str], order: str, name: str, *fields: Column) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_v"))), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["_v"]).alias(name))


def transcript_context(attributed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per session: text, utterances with their speakers, how many are assigned."""
    fields = [F.col("utterance").alias("segmentIndex"), "text", time_range().alias("range"), F.col("confidence").alias("transcriptionConfidence"), "alternatives", F.col("is_final").alias("isFinal"), "speaker", F.col("speaker_confidence").alias("speakerConfidence"), F.col("method").alias("assignmentMethod"), F.coalesce("segments", F.expr("cast(array() as array<bigint>)")).alias("speakerSegmentIndices")]
    rows = _listed(attributed, keys, "utterance", "segments", *[F.col(f) if isinstance(f, str) else f for f in fields])
    counts = attributed.groupBy(*keys).agg(F.count("speaker").alias("assignedSegmentCount"), F.count_if(F.col("speaker").isNull()).alias("unassignedSegmentCount"))
    out = rows.join(counts, list(keys)).withColumn("text", F.concat_ws("", F.transform("segments", lambda s: s["text"])))
    return out.select(*keys, F.struct("text", "segments", "assignedSegmentCount", "unassignedSegmentCount").alias("transcript"))


PROFILE_PARTS = {"rms": "rms", "pitch_hz": "pitchHz", "pitch_confidence": "pitchConfidence", "centroid_hz": "centroidHz", "flatness": "flatness", "consistency": "consistency", "raw_quality": "rawQuality", "enhanced_quality": "enhancedQuality", "recovered_fraction": "recoveredObservationFraction", "view_agreement": "viewAgreement"}


def _speakers(result: Result, keys: Sequence[str]) -> DataFrame:
    full = full_profiles(result, keys)
    parts = [F.col(c).alias(n) for c, n in PROFILE_PARTS.items() if c in full.columns]
    return _listed(full, keys, "speaker", "speakers", F.col("speaker"), F.col("observation_count").alias("observationCount"), F.col("observed_s").alias("observedDurationSeconds"), F.col("centroid").alias("acousticCentroid"), F.col("dispersion").alias("acousticDispersion"), F.col("evidence_count").alias("embeddingEvidenceCount"), F.col("embedding_dispersion").alias("embeddingDispersion"), *parts)


def _observations(result: Result, keys: Sequence[str]) -> DataFrame:
    return _listed(result.observations, keys, "obs_id", "speakerObservations", F.col("obs_id").alias("id"), time_range().alias("range"), F.col("frame_ids").alias("acousticObservationIDs"), F.col("values").alias("featureValues"), F.col("coordinates").alias("featureCoordinates"), F.col("quality_score").alias("qualityScore"), F.col("embedding").alias("embeddingValues"), F.col("agreement.combined").alias("viewAgreement"))


def _decisions(result: Result, keys: Sequence[str]) -> DataFrame:
    known = result.observations.select(*keys, "obs_id", F.struct(F.col("noise_likelihood").alias("noiseLikelihood"), F.col("n_sources").alias("sourceObservationCount"), "taper", "reliability").alias("_rel"))
    rows = result.assignments.join(known, [*keys, "obs_id"])
    return _listed(rows, keys, "obs_id", "speakerDecisions", F.col("obs_id").alias("observationID"), F.col("speaker").alias("acousticSpeaker"), F.col("resolved_speaker").alias("resolvedSpeaker"), F.col("confidence").alias("acousticConfidence"), F.col("evidence_strength").alias("acousticEvidenceStrength"), F.col("changed_by_continuity").alias("changedByContinuity"), F.col("resolved_confidence").alias("resolvedConfidence"), F.col("_rel").alias("reliability"), F.col("candidates"), F.col("transition").alias("temporalTransition"))


def _acoustics(frames: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    signal = F.struct("rms", "peak", F.col("zcr").alias("zeroCrossingRate"), F.col("clip").alias("clippingFraction"))
    spectral = F.struct(F.col("centroid_hz").alias("centroidHz"), F.col("spread_hz").alias("spreadHz"), F.col("rolloff_hz").alias("rolloffHz"), "flatness", F.col("pitch_hz").alias("pitchHz"), F.col("pitch_conf").alias("pitchConfidence"), F.col("voiced_prob").alias("voicedProbability"), F.col("log_mel").alias("logMelEnergies"), "mfcc")
    steady = F.struct(F.col("energy_delta_db").alias("energyDeltaDB"), F.col("spectral_delta").alias("spectralDelta"), F.col("mfcc_delta").alias("mfccDelta"), F.col("pitch_delta").alias("pitchDeltaSemitones"), F.col("consistency").alias("consistencyScore"), F.col("transient").alias("transientLikelihood"))
    quality = F.struct(F.col("quality_score").alias("score"), F.col("usable").alias("isUsableForSpeakerProfile"), "issues")
    return _listed(frames, keys, "id", name, F.col("id"), time_range().alias("range"), signal.alias("signal"), spectral.alias("spectral"), steady.alias("consistency"), F.col("activity"), quality.alias("quality"))


def _noise(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = {"lowEnergy": "noise_low_energy", "flatness": "noise_flatness_evidence", "stationarity": "noise_stationarity_evidence", "pitchUnreliability": "noise_pitch_unreliability", "transient": "noise_transient"}
    return _listed(evidence, keys, "id", "noiseEvidence", F.col("id").alias("observationID"), F.col("noise_likelihood").alias("likelihood"), *[F.col(c).alias(n) for n, c in parts.items()])


def full_profiles(result: Result, keys: Sequence[str] = KEYS) -> DataFrame:
    """Profiles with what a speaker's embeddings and frames say, over observations that smoothing left alone."""
    by = [*keys, "speaker"]
    own = result.assignments.where("not changed_by_continuity").select(*by, "obs_id")
    rows = own.join(result.observations.select(*keys, "obs_id", "frame_ids", "agreement", "embedding"), [*keys, "obs_id"])
    spoken = embedding_profiles(rows, by, "embedding").select(*by, "evidence_count", F.col("dispersion").alias("embedding_dispersion"))
    out = result.profiles.join(spoken, by, "left")
    if result.frames is None:
        return out
    return out.join(acoustic_profiles(rows.select(*by, "frame_ids", "agreement"), result.frames, keys, result.enhanced), by, "left")


def write_context(contexts: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """One JSON line per session, a folder for each."""
    context_json(contexts, keys).write.partitionBy(*keys).text(path)


def context(result: Result, attributed: DataFrame | None, detail: str = "conversation", keys: Sequence[str] = KEYS, alignment: AlignmentConfig = AlignmentConfig()) -> DataFrame:
    """One row per session: ``context``, a struct whose parts depend on the level.

    conversation: transcript and speakers. diagnostic: settings, observations
    and decisions as well. complete: also all frames and noise evidence.
    """
    if detail not in LEVELS:
        raise ValueError(f"detail is one of {LEVELS}")
    parts = [_speakers(result, keys)]
    if attributed is not None:
        parts.append(transcript_context(attributed, keys))
    if detail != "conversation":
        parts += [_observations(result, keys), _decisions(result, keys)]
    if detail == "complete":
        parts.append(_acoustics(result.frames, keys, "rawAcoustic"))
        if result.enhanced is not None:
            parts.append(_acoustics(result.enhanced, keys, "enhancedAcoustic"))
        if result.evidence is not None:
            parts.append(_noise(result.evidence, keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full")
    names = [c for c in out.columns if c not in keys]
    fields = [F.lit(detail).alias("detail"), *names]
    if detail != "conversation":
        settings = {"diarization": asdict(result.config), "alignment": asdict(alignment), "clusteringRepresentation": result.representation}
        fields.append(F.lit(json.dumps(settings, sort_keys=True)).alias("inference"))
    return out.select(*keys, F.struct(*fields).alias("context"))


def context_json(contexts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return contexts.select(*keys, F.to_json("context").alias("json"))


def pretty(line: str) -> str:
    """A context's JSON with sorted keys and a closing line feed."""
    return json.dumps(json.loads(line), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def json_schema(contexts: DataFrame) -> dict:
    """The context's fields and types."""
    return json.loads(contexts.schema["context"].dataType.json())


def attributed_line(start: str = "start_s", end: str = "end_s", speaker: str = "speaker", confidence: str = "speaker_confidence", text: str = "text") -> Column:
    """`[from ... to] speaker confidence  text`, or `[no-time] ...` without a range."""
    time = F.concat(F.lit("["), decimals(start, 2), F.lit(" ... "), decimals(end, 2), F.lit("]"))
    sure = F.coalesce(F.concat(F.lit(" "), decimals(confidence, 2)), F.lit(""))
    return F.concat(F.coalesce(time, F.lit("[no-time]")), F.lit(" "), F.coalesce(F.col(speaker), F.lit("unassigned")), sure, F.lit("  "), F.col(text))


def profile_line() -> Column:
    from ..functions.vectors import rms_magnitude

    return F.concat(F.col("speaker"), F.lit(": observations="), F.col("observation_count").cast("string"), F.lit(" duration="), decimals("observed_s", 2), F.lit("s dispersion="), decimals(rms_magnitude("dispersion"), 4))


def span_line() -> Column:
    return F.concat(decimals("start_s", 2), F.lit("..."), decimals("end_s", 2), F.lit(" "), F.col("baseline_speaker"), F.lit(" -> "), F.col("replay_speaker"), F.lit(" ("), F.col("n_observations").cast("string"), F.lit(" observations)"))


def comparison_line() -> Column:
    return F.concat(F.lit("acoustic changes "), F.col("clustering_changes").cast("string"), F.lit(", resolved changes "), F.col("resolved_changes").cast("string"), F.lit(", segments "), F.col("n_segments").cast("string"), F.lit(", speakers "), F.col("n_speakers").cast("string"), F.lit(", weighted SSE "), optional_decimals(F.when(F.col("representation") == "acoustic", F.col("cost"))), F.lit(", normalized SSE "), optional_decimals("normalized_cost"))


def enhancement_summary(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return blocks.groupBy(*keys).agg(F.count("*").alias("block_count"), distribution("gain_db").alias("gain_db"), distribution("input_rms_db").alias("input_rms_db"), distribution("output_rms_db").alias("output_rms_db"))


def diagnostics(result: Result, attributed: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of a session: frames, usable frames, observations, speakers, turns, corrections, assigned utterances by method."""
    f = result.frames.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.count_if("usable").alias("n_usable"))
    a = result.assignments.groupBy(*keys).agg(F.count("*").alias("n_observations"), F.count_if("changed_by_continuity").alias("n_corrections"))
    parts = [a, result.segments.groupBy(*keys).agg(F.count("*").alias("n_segments")), result.speakers(keys).groupBy(*keys).agg(F.count("*").alias("n_speakers"))]
    if attributed is not None:
        parts.append(attributed.groupBy(*keys).agg(F.count("*").alias("n_utterances"), F.count("speaker").alias("n_assigned"), *[F.count_if(F.col("method") == m).alias(n) for m, n in (("temporalOverlap", "n_direct"), ("bridgedGap", "n_bridged"), ("nearestEvidence", "n_nearest"))]))
    for p in parts:
        f = f.join(p, list(keys), "left")
    return f.fillna(0)
