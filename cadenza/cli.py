"""`python -m cadenza.cli analyze AUDIO ...`: speakers of WAV files, as turns, trace and context.

Transcripts and embeddings come as Parquet tables (session_id, segment_index,
text, start_s, duration_s, ... and session_id, obs_id, embedding).
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import dataclass

from .config import DiarizationConfig, FeatureWeights, HybridWeights
from .plans.context import LEVELS


@dataclass(frozen=True)
class Options:
    audio: str
    locale: str
    speakers: int | None
    maximum_speakers: int
    trace: str | None
    context: str | None
    detail: str
    transcript: str | None
    embeddings: str | None
    evidence: str
    hybrid: HybridWeights | None
    ablation: bool
    calibration: bool


def parse(argv: list[str]) -> Options:
    """Options of a command line; impossible ones end the program with a message."""
    p = argparse.ArgumentParser(prog="cadenza")
    a = p.add_subparsers(dest="command", required=True).add_parser("analyze")
    a.add_argument("audio")
    a.add_argument("-l", "--locale", default="nl-NL")
    a.add_argument("-s", "--speaker-count", type=int)
    a.add_argument("--max-speakers", type=int)
    a.add_argument("-t", "--trace-output")
    a.add_argument("-c", "--context")
    a.add_argument("--context-detail", choices=LEVELS, default="conversation")
    a.add_argument("--transcript")
    a.add_argument("--speaker-embeddings")
    a.add_argument("--speaker-evidence", choices=["acoustic", "embedding", "hybrid"], default="acoustic")
    a.add_argument("--acoustic-weight", type=float)
    a.add_argument("--embedding-weight", type=float)
    a.add_argument("--speaker-ablation", action="store_true")
    a.add_argument("--speaker-calibration", action="store_true")
    o = p.parse_args(argv)
    if not o.audio.strip():
        p.error("an audio path is needed")
    if o.speaker_count is not None and o.speaker_count <= 0:
        p.error(f"the speaker count must be positive, not {o.speaker_count}")
    most = o.max_speakers if o.max_speakers is not None else max(4, o.speaker_count or 0)
    if most <= 0 or most < (o.speaker_count or 0):
        p.error(f"the greatest number of speakers must be positive and at least the expected one, not {most}")
    if o.speaker_evidence != "acoustic" and not o.speaker_embeddings:
        p.error("embedding or hybrid evidence needs --speaker-embeddings")
    hybrid = None
    if o.speaker_evidence == "hybrid":
        weight = lambda w: 0.5 if w is None else w
        try:
            hybrid = HybridWeights(weight(o.acoustic_weight), weight(o.embedding_weight))
        except ValueError as e:
            p.error(str(e))
    elif o.acoustic_weight is not None or o.embedding_weight is not None:
        p.error("weights of evidence go with --speaker-evidence hybrid only")
    return Options(o.audio.strip(), o.locale.strip() or "nl-NL", o.speaker_count, most, o.trace_output, o.context, o.context_detail, o.transcript, o.speaker_embeddings, o.speaker_evidence, hybrid, o.speaker_ablation, o.speaker_calibration)


def run(o: Options) -> None:
    from .operators import alignment as A
    from .operators import dsp
    from .plans import context as X
    from .plans import diarization as P
    from .plans import export as E
    from .session import local_session, retained, ship
    from .sources import enhancement, signals, transcripts
    from .streaming.frames import one_shot

    spark = local_session()
    ship(spark)
    clock, took = time.perf_counter(), {}

    def lap(name: str) -> None:
        nonlocal clock
        took[name], clock = time.perf_counter() - clock, time.perf_counter()

    chunks = signals.read_wav(spark, o.audio)
    louder = enhancement.enhanced_chunks(chunks)
    frames, second = retained(one_shot(dsp.frames(chunks))), retained(one_shot(dsp.frames(louder)))
    lap("acoustic DSP")
    config = DiarizationConfig(expected_speakers=o.speakers, maximum_speakers=o.maximum_speakers)
    embeddings = spark.read.parquet(o.embeddings) if o.embeddings else None
    result = P.diarize(frames, config, enhanced=second, embeddings=embeddings)
    lap("speaker diarization")
    if o.evidence != "acoustic":
        result = P.replay(result, representation=o.evidence, hybrid=o.hybrid)
        lap("speaker embeddings")
    told = None
    if o.transcript:
        words = transcripts.transcript(spark.read.parquet(o.transcript))
        told = A.attributed(words, A.aligned(words, result.segments, P.KEYS), P.KEYS)
        lap("alignment")
    for r in X.diagnostics(result, told).collect():
        print(", ".join(f"{k}: {v}" for k, v in r.asDict().items()))
    for r in result.profiles.select("session_id", X.profile_line().alias("line")).orderBy("session_id", "line").collect():
        print(f"{r['session_id']}  {r['line']}")
    if told is not None:
        for r in told.orderBy("session_id", "utterance").select(X.attributed_line().alias("line")).toLocalIterator():
            print(r["line"])
    if o.ablation:
        for r in P.leave_one_out(result).orderBy("session_id", "ablation_no").select("ablation", X.comparison_line().alias("line")).collect():
            print(f"{r['ablation']}: {r['line']}")
    if o.calibration:
        weights = FeatureWeights()
        for r in P.experiment(result, [("per coordinate", weights, "perCoordinate"), ("normalized families", weights, "normalizedFamily")]).orderBy("session_id", "candidate_no").select("candidate", X.comparison_line().alias("line")).collect():
            print(f"{r['candidate']}: {r['line']}")
    if o.trace:
        E.write_trace(result, o.trace, enhancement.blocks(louder))
    if o.context:
        X.write_context(X.context(result, told, o.detail), o.context)
    lap("reports")
    for name, seconds in took.items():
        print(f"{name}: {seconds:.3f}s")


if __name__ == "__main__":
    run(parse(sys.argv[1:]))
