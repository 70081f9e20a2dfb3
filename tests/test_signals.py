from __future__ import annotations

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.config import AcousticConfig, DiarizationConfig, GroupingConfig, HybridWeights
from cadenza.operators import dsp
from cadenza.plans import context as CX
from cadenza.plans import diarization as P
from cadenza.plans import export as E
from cadenza.sources import signals as G
from cadenza.streaming.frames import assembled, frame_stream, one_shot

TWO = np.concatenate([x for _ in range(2) for x in (G.sine(140, 0.8), G.silence(0.2), G.sine(270, 0.8), G.silence(0.2))][:-1])
MISSING = G.sine(156.25, 0.6, 0.18) + G.sine(234.375, 0.6, 0.18)
RAMP = G.sine(181, 0.65, 0.2) * np.linspace(0.5, 1, int(0.65 * 16000)).astype(np.float32)


@pytest.fixture(scope="module")
def frames(spark):
    made = {"voiced": G.sine(180, 0.5), "silence": G.silence(0.25), "noise": G.alternating(0.25), "p181": G.sine(181, 0.6), "p420": G.sine(420, 0.6), "harmonic": G.sine(220, 0.6, 0.12) + G.sine(440, 0.6, 0.24), "missing": MISSING, "two": TWO}
    return one_shot(dsp.frames(G.chunk_table(spark, made))).cache()


def rows(frames, session):
    return frames.where(F.col("session_id") == session).orderBy("id").collect()


def test_activity(frames):
    assert all(r["activity"] == "silence" and not r["usable"] for r in rows(frames, "silence"))
    noise = rows(frames, "noise")
    assert any(r["activity"] == "noise" for r in noise) and not any(r["usable"] for r in noise)
    voiced = [r for r in rows(frames, "voiced") if r["activity"] == "voicedSpeech"]
    assert voiced and all(len(r["mfcc"]) == 13 and len(r["log_mel"]) == 24 and r["pitch_hz"] is not None for r in voiced)


def test_pitch(frames):
    median = lambda s: float(np.median([r["pitch_hz"] for r in rows(frames, s) if r["pitch_hz"] is not None]))
    assert abs(median("p181") - 181) <= 3
    assert abs(median("p420") - 420) <= 6
    assert abs(median("harmonic") - 220) <= 5
    assert median("missing") > 120
    low = [r for r in rows(frames, "missing") if r["pitch_hz"] is not None and abs(r["pitch_hz"] - 78.125) <= 1]
    assert len(low) < 0.1 * len(rows(frames, "missing"))
    assert all(r["pitch_hz"] is None and r["pitch_conf"] < 0.25 for r in rows(frames, "silence"))


def test_frame_grid(frames):
    r = rows(frames, "voiced")
    assert [x["id"] for x in r] == list(range(len(r)))
    assert r[1]["start_s"] - r[0]["start_s"] == pytest.approx(0.016, abs=1e-9)
    assert r[0]["end_s"] - r[0]["start_s"] == pytest.approx(0.032, abs=1e-9)
    assert r[0]["consistency"] == 1 and r[0]["transient"] == 0


def batches(chunk, **how):
    acc = dsp.Accumulator(AcousticConfig(), **how)
    out = []
    n = int(chunk * 16000)
    for i in range(0, len(RAMP), n):
        out += acc.consume("s", 16000, RAMP[i : i + n], i / 16000)
    out += acc.finish("s")
    return sum(b.num_rows for b in out), np.concatenate([np.asarray(b.column("rms")) for b in out if b.num_rows])


def test_batching_does_not_change_frames():
    n, rms = batches(10.0, batch_seconds=4.0)
    for chunk in (0.01, 0.037, 0.1, 0.3):
        k, other = batches(chunk, batch_seconds=0.1)
        assert k == n
        assert np.allclose(rms, other)


def test_discontinuity_rate_change_and_finish():
    acc = dsp.Accumulator()
    list(acc.consume("s", 16000, G.sine(180, 0.2), 0.0))
    got = list(acc.consume("s", 16000, G.sine(180, 0.2), 5.0))
    assert got and acc.pending_start == 5.0
    with pytest.raises(ValueError, match="sample rate"):
        list(acc.consume("s", 8000, G.sine(180, 0.2), 5.2))
    list(acc.finish("s"))
    with pytest.raises(ValueError, match="finished"):
        list(acc.consume("s", 16000, G.sine(180, 0.2), 6.0))


def test_rates():
    for rate in (16000, 48000):
        b = dsp.frame_batch("s", rate, 2.0, G.sine(181, 0.81, rate=rate), AcousticConfig())
        assert len(b.column("mfcc")[0]) == 13
        starts = np.asarray(b.column("start_s"))
        assert starts.min() == 2.0 and np.asarray(b.column("end_s")).max() <= 2.81 + 1e-9


def test_stream_matches_batch(spark, tmp_path):
    chunks = G.chunk_table(spark, {"ramp": RAMP, "two": TWO}, chunk_seconds=0.1)
    last = F.col("chunk_index") == F.max("chunk_index").over(__import__("pyspark").sql.Window.partitionBy("session_id"))
    chunks.withColumn("is_last", last).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = frame_stream(source, batch_seconds=0.1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = assembled(spark.read.parquet(str(tmp_path / "out"))).orderBy("session_id", "id").collect()
    batch = one_shot(dsp.frames(chunks)).orderBy("session_id", "id").collect()
    assert [(r["session_id"], r["id"]) for r in streamed] == [(r["session_id"], r["id"]) for r in batch]
    assert np.allclose([r["rms"] for r in streamed], [r["rms"] for r in batch])
    assert np.allclose([r["consistency"] for r in streamed], [r["consistency"] for r in batch])


CONFIG = DiarizationConfig(grouping=GroupingConfig(0.25, 1.0, 0.08))


@pytest.fixture(scope="module")
def result(spark, frames):
    two = frames.where("session_id = 'two'")
    r = P.diarize(two, CONFIG)
    embedding = F.when(F.col("obs_id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.05))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>")
    return P.diarize(two, CONFIG, enhanced=two, embeddings=r.observations.select("session_id", "obs_id", embedding.alias("embedding")))


def test_two_speakers(result):
    assert [r["speaker"] for r in result.segments.orderBy("segment_index").collect()] == ["speaker_1", "speaker_2"] * 2
    assert result.profiles.count() == 2
    assert result.speakers().count() == 2


def test_replays(result):
    same = P.comparison(result, P.replay(result)).first()
    assert same["clustering_changes"] == same["resolved_changes"] == 0 and same["cost"] == pytest.approx(result.evaluation.first()["cost"])
    assert P.leave_one_out(result).count() == 8
    hybrids = {r["candidate"]: r for r in P.hybrid_experiment(result, [("acoustic", HybridWeights(1, 0)), ("embedding", HybridWeights(0, 1))]).collect()}
    assert set(hybrids) == {"acoustic", "embedding"} and hybrids["acoustic"]["clustering_changes"] == 0


def test_contributions_add_up(result):
    parts = P.contributions(result).groupBy("obs_id").agg(F.sum("squared_distance").alias("d"))
    total = result.assignments.select("obs_id", F.expr("filter(candidates, c -> c.speaker = speaker)[0].distance").alias("t"))
    for r in parts.join(total, "obs_id").collect():
        assert r["d"] == pytest.approx(r["t"], abs=1e-8)


def test_trace_and_context(result, frames):
    lines = E.trace_csv(result).collect()
    assert len(lines) == len(rows(frames, "two")) + 1
    assert all(r["line"].count(",") == len(E.TRACE) - 1 for r in lines)
    for level, has in (("conversation", False), ("diagnostic", True), ("complete", True)):
        c = CX.context(result, None, level)
        names = c.schema["context"].dataType.names
        assert ("speakerDecisions" in names) == has and ("rawAcoustic" in names) == (level == "complete")
    assert CX.pretty(CX.context_json(CX.context(result, None)).first()["json"]).endswith("}\n")
    with pytest.raises(ValueError):
        CX.context(result, None, "everything")


def test_wav(spark, tmp_path):
    x = G.sine(200, 0.1)
    for width in (1, 2, 4):
        data = ((x * 127 + 128).astype(np.uint8) if width == 1 else (x * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}")).tobytes()
        b = io.BytesIO()
        with wave.open(b, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(16000)
            w.writeframes(data)
        (tmp_path / f"{width}.wav").write_bytes(b.getvalue())
        rate, y = G.decode_wav(b.getvalue())
        assert rate == 16000 and np.allclose(x, y, atol=0.02)
    assert G.read_wav(spark, str(tmp_path), 0.05).count() == 6


def test_sample_range(spark):
    df = spark.createDataFrame([(12.25, 12.75, 12.0, 16000, 16000), (20.0, 20.5, 12.0, 16000, 16000)], "s double, e double, a double, r int, n int")
    assert [tuple(r["x"]) if r["x"] else None for r in df.select(G.sample_range("s", "e", "a", "r", "n").alias("x")).collect()] == [(4000, 12000), None]


def test_reports(result):
    from cadenza.config import FeatureWeights
    from cadenza.plans import reports as RP

    other = P.replay(result, representation="embedding")
    assert RP.embedding_counts(result).first()["n_missing"] == 0
    assert RP.change_span_lines(result, other).count() == RP.changes(result, other).count() == 0
    swapped = P.replace(result, assignments=result.assignments.withColumn("resolved_speaker", F.lit("speaker_9")))
    line = RP.changes(result, swapped).select(RP.change_line().alias("l")).first()["l"]
    assert "-> speaker_9, confidence" in line
    assert RP.change_span_lines(result, swapped).count() >= 2
    assert RP.weights_line(FeatureWeights()).startswith("mfcc 1.000, logMel 0.750")
    assert RP.timing_lines({"a": 1.0, "b": 0.0})[-1] == "total wall time: 1.000s"
    assert "weighted SSE" in RP.clustering_line(result.evaluation).first()["line"]
    profiles = CX.full_profiles(result)
    assert profiles.select(RP.embedding_profile_line().alias("l")).first()["l"].startswith("speaker_")
