"""Report lines of a run: timings, embeddings, replays, ablations, experiments, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FAMILIES, FeatureWeights
from ..functions.text import decimals, optional_decimals
from ..operators import segments as S
from .context import comparison_line, span_line
from .diarization import KEYS, Result

#: Changes that follow within this many seconds are one span.
SPAN_GAP = 0.35


def timing_lines(seconds: dict[str, float]) -> list[str]:
    """One line per stage and the total; stages that took no time are left out."""
    kept = {k: v for k, v in seconds.items() if v > 0}
    return [*(f"{k}: {v:.3f}s" for k, v in kept.items()), f"total wall time: {sum(kept.values()):.3f}s"]


def embedding_counts(result: Result, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per session: observations, those with an embedding, those without, and the embeddings' dimension."""
    has = F.col("embedding").isNotNull()
    return result.observations.groupBy(*keys).agg(F.count("*").alias("n_requested"), F.count_if(has).alias("n_embedded"), F.count_if(~has).alias("n_missing"), F.max(F.when(has, F.size("embedding"))).alias("dimension"))


def changes(source: Result, other: Result, keys: Sequence[str] = KEYS, resolved: bool = True) -> DataFrame:
    """Observations that changed their speaker, with both confidences; a changed one may have no resolved confidence."""
    label, sure = ("resolved_speaker", "resolved_confidence") if resolved else ("speaker", "confidence")
    moved = S.compared(source.assignments, other.assignments, keys, label)
    of = lambda r, name: r.assignments.select(*keys, "obs_id", F.col(sure).alias(name))
    return moved.join(of(source, "baseline_confidence"), [*keys, "obs_id"]).join(of(other, "replay_confidence"), [*keys, "obs_id"])


def change_line() -> Column:
    """`from...to speaker -> speaker, confidence a -> b`."""
    return F.concat(decimals("start_s", 2), F.lit("..."), decimals("end_s", 2), F.lit(" "), F.col("baseline_speaker"), F.lit(" -> "), F.col("replay_speaker"), F.lit(", confidence "), optional_decimals("baseline_confidence"), F.lit(" -> "), optional_decimals("replay_confidence"))


def change_span_lines(source: Result, other: Result, keys: Sequence[str] = KEYS, resolved: bool = True) -> DataFrame:
    """(keys, span, line) of changes merged within SPAN_GAP."""
    spans = S.change_spans(changes(source, other, keys, resolved), keys, "baseline_speaker", "replay_speaker", SPAN_GAP, ["obs_id"])
    return spans.select(*keys, "span", span_line().alias("line"))


def weights_line(weights: FeatureWeights) -> str:
    return ", ".join(f"{n} {getattr(weights, n):.3f}" for n in (*FAMILIES, "enhancedView"))


def clustering_line(evaluation: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, line) with cost and cost per unit of weight."""
    return evaluation.select(*keys, F.concat(F.lit("weighted SSE "), decimals("cost", 4), F.lit(", normalized SSE "), optional_decimals("normalized_cost", 4)).alias("line"))


def ablation_lines(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, ablation, line) of ``leave_one_out``'s rows."""
    return rows.select(*keys, "ablation_no", "ablation", comparison_line().alias("line"))


def embedding_profile_line() -> Column:
    return F.concat(F.col("speaker"), F.lit(" observations "), F.col("observation_count").cast("string"), F.lit(", duration "), decimals("observed_s", 2), F.lit("s, embedding evidence "), F.col("evidence_count").cast("string"), F.lit(", cosine dispersion "), decimals("embedding_dispersion", 4))
