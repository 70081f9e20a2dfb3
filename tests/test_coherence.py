"""Smoothing on fully specified cost tables."""

from __future__ import annotations

import pytest

from cadenza.operators.coherence import smooth, smooth_sessions

# (speaker, confidence, cost of s1, cost of s2)
X, Y = ("s2", 0.9, 1.0, 0.1), ("s1", 0.9, 0.1, 1.0)


def resolve(rows, reliability=None, starts=None):
    starts = starts or [0.4 * i for i in range(len(rows))]
    reliability = reliability or [1.0] * len(rows)
    return smooth(starts, [s + 0.4 for s in starts], [["s1", "s2"]] * len(rows), [[r[2], r[3]] for r in rows], [r[0] for r in rows], [r[1] for r in rows], reliability)


@pytest.mark.parametrize(
    ("rows", "reliability", "starts", "expected"),
    [
        ([X, X, ("s1", 0.08, 0.92, 1.0), X, X], None, None, "s2 s2 s2 s2 s2"),
        ([X, Y, X], None, None, "s2 s1 s2"),
        ([X, Y, X], [1, 0.1, 1], None, "s2 s2 s2"),
        ([X, ("s1", 0.55, 0.45, 1.0), X], None, None, "s2 s1 s2"),
        ([X, X, ("s1", 0.35, 0.65, 1.0), Y], None, None, "s2 s2 s1 s1"),
        ([X, X, Y, Y, Y], None, None, "s2 s2 s1 s1 s1"),
        ([X, ("s1", 0.25, 0.75, 1.0)], None, [0, 1.5], "s2 s1"),
        ([X, X, *[("s1", 0.25, 0.75, 1.0)] * 3], None, None, "s2 s2 s1 s1 s1"),
    ],
)
def test_tables(rows, reliability, starts, expected):
    assert resolve(rows, reliability, starts)[0] == expected.split()


def test_single_speaker_and_empty_stay():
    assert smooth([0.0], [1.0], [["a"]], [[0.0]], ["a"], [1.0], [1.0]) == (["a"], [None])
    assert smooth([], [], [], [], [], [], []) == ([], [])


def test_speakers_sort_as_text():
    names = [["speaker_10", "speaker_2"]] * 2
    got, _ = smooth([0, 1], [1, 2], names, [[0.5, 0.5]] * 2, ["speaker_2"] * 2, [0, 0], [1, 1])
    assert got == ["speaker_10", "speaker_10"]


def test_sessions(spark):
    rows = [("a", i, 0.4 * i, 0.4 * i + 0.4, ["s1", "s2"], [r[2], r[3]], r[0], r[1], 1.0) for i, r in enumerate([X, X, ("s1", 0.08, 0.92, 1.0), X, X])]
    df = spark.createDataFrame(rows, "session_id string, obs_id long, start_s double, end_s double, speakers array<string>, costs array<double>, speaker string, confidence double, reliability double")
    got = {r["obs_id"]: r for r in smooth_sessions(df, ["session_id"]).collect()}
    assert got[2]["changed_by_continuity"] and got[2]["resolved_confidence"] is None and got[2]["evidence_strength"] == pytest.approx(0.08)
    assert got[0]["transition"] is None and got[1]["transition"]["cost"] == 0
