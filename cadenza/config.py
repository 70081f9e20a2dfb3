"""Settings of every stage. The defaults are fixed values that results depend on."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

FAMILIES = ("mfcc", "logMel", "pitch", "spectral", "dynamics", "consistency", "quality")
ABLATION_TARGETS = (*FAMILIES, "enhancedView")


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class AcousticConfig:
    frame_seconds: float = 0.032
    hop_seconds: float = 0.016
    minimum_fft_size: int = 1024
    rolloff_fraction: float = 0.85
    minimum_pitch_hz: float = 70.0
    maximum_pitch_hz: float = 450.0
    minimum_pitch_evidence: float = 0.12
    minimum_pitch_confidence: float = 0.15
    silence_rms: float = 0.006
    adaptive_noise_multiplier: float = 2.5
    clipping_threshold: float = 0.995
    maximum_clipping_fraction: float = 0.01
    maximum_speech_flatness: float = 0.65
    maximum_speech_zcr: float = 0.35
    minimum_profile_quality: float = 0.55
    mel_filters: int = 24
    mfcc_count: int = 13

    def __post_init__(self):
        _require(self.frame_seconds > 0 and self.hop_seconds > 0, "frame and hop must be positive")
        _require(0 < self.rolloff_fraction <= 1, "rolloff fraction must be in (0, 1]")
        _require(0 < self.minimum_pitch_hz < self.maximum_pitch_hz, "pitch range must be positive and ordered")
        _require(0 < self.mfcc_count <= self.mel_filters, "mfcc count must be positive and at most the filters")

    def frame_length(self, rate: int) -> int:
        return max(1, half_away(rate * self.frame_seconds))

    def hop_length(self, rate: int) -> int:
        return max(1, half_away(rate * self.hop_seconds))

    def fft_size(self, rate: int) -> int:
        return 1 << max(0, (max(self.frame_length(rate), self.minimum_fft_size) - 1).bit_length())


@dataclass(frozen=True)
class FeatureWeights:
    mfcc: float = 1.0
    logMel: float = 0.75
    pitch: float = 0.65
    spectral: float = 0.45
    dynamics: float = 0.15
    consistency: float = 0.35
    quality: float = 0.25
    enhancedView: float = 0.45

    def ablating(self, target: str) -> FeatureWeights:
        _require(target in ABLATION_TARGETS, f"no such target: {target}")
        return replace(self, **{target: 0.0})


@dataclass(frozen=True)
class GroupingConfig:
    minimum_seconds: float = 0.35
    maximum_seconds: float = 1.5
    maximum_gap_seconds: float = 0.12
    weights: FeatureWeights = field(default_factory=FeatureWeights)

    def __post_init__(self):
        _require(0 < self.minimum_seconds <= self.maximum_seconds and self.maximum_gap_seconds >= 0, "durations must be positive and ordered")


@dataclass(frozen=True)
class ReliabilityConfig:
    full_authority_noise: float = 0.55
    minimum_authority_noise: float = 0.80
    minimum_reliability: float = 0.20

    def __post_init__(self):
        _require(0 <= self.full_authority_noise <= self.minimum_authority_noise <= 1 and 0 <= self.minimum_reliability <= 1, "bounds must be ordered within [0, 1]")


@dataclass(frozen=True)
class CoherenceConfig:
    switch_penalty: float = 0.35
    maximum_gap_seconds: float = 0.45

    def __post_init__(self):
        _require(self.switch_penalty >= 0 and self.maximum_gap_seconds >= 0, "penalty and gap must not be negative")


@dataclass(frozen=True)
class DiarizationConfig:
    expected_speakers: int | None = None
    maximum_speakers: int = 4
    minimum_per_cluster: int = 2
    minimum_improvement: float = 0.35
    maximum_iterations: int = 32
    merge_gap_seconds: float = 0.15
    weighting: str = "perCoordinate"
    coherence: CoherenceConfig = field(default_factory=CoherenceConfig)
    reliability: ReliabilityConfig = field(default_factory=ReliabilityConfig)
    acoustic: AcousticConfig = field(default_factory=AcousticConfig)
    grouping: GroupingConfig = field(default_factory=GroupingConfig)

    def __post_init__(self):
        _require(self.expected_speakers is None or self.expected_speakers > 0, "expected speakers must be positive")
        _require(self.maximum_speakers > 0 and self.minimum_per_cluster > 0 and self.maximum_iterations > 0, "counts must be positive")
        _require(self.minimum_improvement >= 0 and self.merge_gap_seconds >= 0, "improvement and gap must not be negative")
        _require(self.weighting in ("perCoordinate", "normalizedFamily"), "weighting is perCoordinate or normalizedFamily")


@dataclass(frozen=True)
class AlignmentConfig:
    maximum_bridge_seconds: float = 0.9
    maximum_nearest_seconds: float = 0.12
    minimum_bridged_confidence: float = 0.10
    minimum_nearest_confidence: float = 0.10

    def __post_init__(self):
        _require(self.maximum_bridge_seconds >= 0 and self.maximum_nearest_seconds >= 0, "distances must not be negative")


@dataclass(frozen=True)
class HybridWeights:
    """Authority of the two kinds of evidence, scaled to a sum of one."""

    acoustic: float
    embedding: float

    def __post_init__(self):
        a, e = self.acoustic, self.embedding
        _require(math.isfinite(a) and math.isfinite(e) and a >= 0 and e >= 0 and a + e > 0, "weights must be finite, not negative, with a positive sum")
        object.__setattr__(self, "acoustic", a / (a + e))
        object.__setattr__(self, "embedding", e / (a + e))


def half_away(x: float) -> int:
    """Rounds to the nearest integer, halves away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)
