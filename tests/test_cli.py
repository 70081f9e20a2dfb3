from __future__ import annotations

import glob
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import cli
from cadenza.sources import enhancement, transcripts
from cadenza.sources import signals as G


def test_options():
    o = cli.parse(["analyze", "a.wav"])
    assert (o.locale, o.maximum_speakers, o.evidence, o.hybrid) == ("nl-NL", 4, "acoustic", None)
    assert cli.parse(["analyze", "a.wav", "-s", "6"]).maximum_speakers == 6
    h = cli.parse(["analyze", "a.wav", "--speaker-embeddings", "e", "--speaker-evidence", "hybrid"]).hybrid
    assert (h.acoustic, h.embedding) == (0.5, 0.5)
    for bad in (["-s", "0"], ["--max-speakers", "0"], ["-s", "5", "--max-speakers", "4"], ["--speaker-evidence", "embedding"], ["--acoustic-weight", "1"], ["--speaker-embeddings", "e", "--speaker-evidence", "hybrid", "--acoustic-weight", "-1"]):
        with pytest.raises(SystemExit):
            cli.parse(["analyze", "a.wav", *bad])


def test_enhancement(spark):
    quiet = G.chunk_table(spark, {"q": G.sine(180, 0.5, 0.0035), "z": G.silence(0.2), "loud": G.sine(180, 0.5, 0.5)})
    got = {r["session_id"]: r for r in enhancement.enhanced_chunks(quiet).collect()}
    assert got["q"]["gain_db"] == pytest.approx(24) and got["q"]["output_rms_db"] > got["q"]["input_rms_db"] + 20
    assert got["z"]["gain_db"] == 0 and got["loud"]["gain_db"] == 0
    assert enhancement.blocks(enhancement.enhanced_chunks(quiet)).count() == 3


def test_transcript(spark):
    rows = spark.createDataFrame([("a", 5, "Hello", 0.0, 1.0), ("a", 9, " world.", float("nan"), 1.0)], "session_id string, segment_index long, text string, start_s double, duration_s double")
    t = transcripts.transcript(rows)
    got = t.orderBy("utterance").collect()
    assert [(r["utterance"], r["start_s"], r["end_s"], r["is_final"]) for r in got] == [(0, 0.0, 1.0, True), (1, None, None, True)]
    assert transcripts.whole_text(t).first()["text"] == "Hello world."


def test_run(spark, tmp_path, capsys, monkeypatch):
    two = np.concatenate([x for _ in range(2) for x in (G.sine(140, 0.8), G.silence(0.2), G.sine(270, 0.8), G.silence(0.2))])
    with wave.open(str(tmp_path / "two.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes((two * 32767).astype("<i2").tobytes())
    name = spark.read.format("binaryFile").load(str(tmp_path / "two.wav")).first()["path"]
    spark.createDataFrame([(name, 0, "hi", 0.1, 0.5), (name, 1, " there", 1.1, 0.4)], "session_id string, segment_index long, text string, start_s double, duration_s double").write.parquet(str(tmp_path / "words"))
    monkeypatch.setattr("cadenza.session.local_session", lambda *a, **k: spark)
    cli.run(cli.parse(["analyze", str(tmp_path / "two.wav"), "--transcript", str(tmp_path / "words"), "-t", str(tmp_path / "trace"), "-c", str(tmp_path / "context"), "--context-detail", "diagnostic"]))
    said = capsys.readouterr().out
    assert "n_utterances: 2" in said and "] speaker_" in said and "acoustic DSP" in said
    lines = spark.read.text(str(tmp_path / "trace")).where(F.col("value") != "").count()
    assert lines > 200
    context = json.loads(open(glob.glob(f"{tmp_path}/context/*/part-*")[0]).read())
    assert context["detail"] == "diagnostic" and len(context["transcript"]["segments"]) == 2 and context["speakers"][0]["pitchHz"]["count"] > 0
