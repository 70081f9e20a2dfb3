from __future__ import annotations

import pytest

from cadenza.config import AlignmentConfig
from cadenza.operators.alignment import aligned, attributed

CASES = [
    ([(0, 0.0, 2.0), (1, 2.0, 4.0)], [("s1", 0, 2.1, 0.95), ("s2", 2.1, 4, 0.91)], {0: ("s1", "temporalOverlap", None, [0]), 1: ("s2", "temporalOverlap", None, [1])}),
    ([(0, 0.0, 2.0)], [("s1", 0, 0.45, 0.8), ("s1", 0.55, 1, 0.8), ("s2", 1.05, 1.75, 0.8)], {0: ("s1", "temporalOverlap", 0.45, [0, 1])}),
    ([(0, 1.05, 1.45)], [("s1", 0, 1, 0.8), ("s1", 1.5, 2.5, 0.75)], {0: ("s1", "bridgedGap", 0.541667, [0, 1])}),
    ([(0, 1.05, 1.40)], [("s1", 0, 1, 0.8), ("s2", 1.45, 2.45, 0.8)], {}),
    ([(0, 1.04, 1.10)], [("s1", 0, 1, 0.9)], {0: ("s1", "nearestEvidence", 0.5625, [0])}),
    ([(0, 2.0, 2.2)], [("s1", 0, 1, 0.9)], {}),
    ([(0, None, None), (1, 0.1, 0.2)], [("s1", 0, 1, None)], {1: ("s1", "temporalOverlap", 0.5, [0])}),
]


def test_cases(spark):
    words = [(f"c{i}", u, s, e) for i, (us, _, _) in enumerate(CASES) for u, s, e in us]
    turns = [(f"c{i}", k, sp, float(a), float(b), c) for i, (_, ss, _) in enumerate(CASES) for k, (sp, a, b, c) in enumerate(ss)]
    t = spark.createDataFrame(words, "session_id string, utterance long, start_s double, end_s double")
    g = spark.createDataFrame(turns, "session_id string, segment_index long, speaker string, start_s double, end_s double, confidence double")
    a = aligned(t, g, ["session_id"], AlignmentConfig(), 1.0)
    got = {(r["session_id"], r["utterance"]): r for r in a.collect()}
    want = {(f"c{i}", u): x for i, (_, _, e) in enumerate(CASES) for u, x in e.items()}
    assert set(got) == set(want)
    for key, (speaker, method, confidence, segments) in want.items():
        r = got[key]
        assert (r["speaker"], r["method"], r["segments"]) == (speaker, method, segments)
        if confidence is not None:
            assert r["confidence"] == pytest.approx(confidence, abs=1e-4)
    assert attributed(t, a, ["session_id"]).count() == len(words)
