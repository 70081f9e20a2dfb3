"""Smoothing of a session's labels: the cheapest path through candidate costs and switch penalties."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import CoherenceConfig

#: What a speaker costs that is no candidate.
MISSING = 1_000_000.0


def gap_scale(gap: float, config: CoherenceConfig) -> float:
    """How much of the penalty applies: all of it without a gap, none from the longest gap on."""
    most = config.maximum_gap_seconds
    return 1 - gap / most if most > 0 and gap < most else 0.0


def smooth(starts: Sequence[float], ends: Sequence[float], names: Sequence[Sequence[str]], costs: Sequence[Sequence[float]], chosen: Sequence[str], confidence: Sequence[float], reliability: Sequence[float], config: CoherenceConfig = CoherenceConfig()) -> tuple[list[str], list[dict | None]]:
    """Resolved speaker and transition of each row.

    Speakers are taken in text order and the first of equal costs wins. With
    one speaker, or none, the labels stay and there are no transitions.
    """
    speakers = sorted({s for row in names for s in row})
    n = len(chosen)
    if not n or len(speakers) < 2:
        return list(chosen), [None] * n
    place = {s: i for i, s in enumerate(speakers)}
    emit = np.full((n, len(speakers)), MISSING)
    for i, (row, cost) in enumerate(zip(names, costs, strict=True)):
        for s, c in reversed(list(zip(row, cost, strict=True))):
            emit[i, place[s]] = max(0.0, c)
    emit *= np.asarray(reliability, float)[:, None]
    strength = np.clip(np.asarray(confidence, float), 0, 1) * np.asarray(reliability, float)
    gaps = np.maximum(0.0, np.asarray(starts[1:], float) - np.asarray(ends[:-1], float))
    scales = [gap_scale(g, config) for g in gaps.tolist()]

    def penalties(i: int) -> np.ndarray:
        """What moving to each speaker at row i costs."""
        relief = np.zeros(len(speakers))
        if chosen[i] in place:
            relief[place[chosen[i]]] = strength[i]
        return config.switch_penalty * scales[i - 1] * (1 - relief)

    total, back = emit[0], np.zeros((n, len(speakers)), int)
    for i in range(1, n):
        move = np.repeat(penalties(i)[None], len(speakers), 0)
        np.fill_diagonal(move, 0.0)
        reach = total[:, None] + move + emit[i][None]
        back[i] = reach.argmin(0)
        total = reach.min(0)
    path = [int(total.argmin())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    moves: list[dict | None] = [None]
    for i in range(1, n):
        a, b = path[i - 1], path[i]
        evidence = float(strength[i]) if a != b and chosen[i] == speakers[b] else 0.0
        moves.append({"previous_speaker": speakers[a], "speaker": speakers[b], "gap_s": float(gaps[i - 1]), "gap_scale": scales[i - 1], "switching_evidence": evidence, "switch_penalty": config.switch_penalty, "cost": float(penalties(i)[b]) if a != b else 0.0, "changed": a != b})
    return [speakers[k] for k in path], moves


TRANSITION = T.StructType(
    [
        T.StructField("previous_speaker", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("gap_s", T.DoubleType()),
        T.StructField("gap_scale", T.DoubleType()),
        T.StructField("switching_evidence", T.DoubleType()),
        T.StructField("switch_penalty", T.DoubleType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("changed", T.BooleanType()),
    ]
)

RESOLVED = [
    T.StructField("resolved_speaker", T.StringType()),
    T.StructField("changed_by_continuity", T.BooleanType()),
    T.StructField("evidence_strength", T.DoubleType()),
    T.StructField("resolved_confidence", T.DoubleType()),
    T.StructField("transition", TRANSITION),
]


def resolved_columns(chosen: Sequence[str], resolved: Sequence[str], confidence: np.ndarray, reliability: np.ndarray, moves: Sequence[dict | None]) -> dict:
    """Columns of RESOLVED: a changed row has no resolved confidence."""
    strength = np.clip(confidence, 0, 1) * reliability
    changed = [a != b for a, b in zip(chosen, resolved, strict=True)]
    return {"resolved_speaker": list(resolved), "changed_by_continuity": changed, "evidence_strength": strength, "resolved_confidence": [None if c else float(s) for c, s in zip(changed, strength, strict=True)], "transition": list(moves)}


def smooth_sessions(df: DataFrame, keys: Sequence[str], config: CoherenceConfig = CoherenceConfig(), order: str = "obs_id") -> DataFrame:
    """Adds RESOLVED to rows with start_s, end_s, speakers, costs, speaker, confidence and reliability."""
    schema = T.StructType([*df.schema.fields, *RESOLVED])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        chosen = rows["speaker"].tolist()
        sure, count = rows["confidence"].to_numpy(float), rows["reliability"].to_numpy(float)
        resolved, moves = smooth(rows["start_s"].tolist(), rows["end_s"].tolist(), rows["speakers"].tolist(), rows["costs"].tolist(), chosen, sure, count, config)
        return rows.assign(**resolved_columns(chosen, resolved, sure, count, moves))

    return df.groupBy(*keys).applyInPandas(run, schema)
