"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AcousticConfig, ReliabilityConfig


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(c: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(c)))


def finite_or_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def time_range(start: Column | str, duration: Column | str) -> Column:
    """A range, or null unless both times are finite numbers."""
    s, d = finite_or_null(start), finite_or_null(duration)
    return F.when(s.isNotNull() & d.isNotNull(), F.struct(s.alias("start_s"), (s + d).alias("end_s"), d.alias("duration_s")))


def decibels(c: Column | str) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(col(c), F.lit(1e-12)))


def semitones(a: Column | str, b: Column | str) -> Column:
    """Distance of two pitches; null unless both are positive."""
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.abs(F.lit(12.0) * F.log2(a / b)))


def crest_factor(peak: Column | str, rms: Column | str) -> Column:
    return F.when(col(rms) > 1e-12, col(peak) / col(rms)).otherwise(F.lit(0.0))


def mel(hz: Column | str) -> Column:
    return F.lit(2595.0) * F.log10(F.lit(1.0) + col(hz) / 700.0)


def hz(mels: Column | str) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), col(mels) / 2595.0) - 1.0)


def next_power_of_two(n: Column | str) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(col(n), F.lit(1)).cast("double")))).cast("long")


def taper(likelihood: Column | str, config: ReliabilityConfig = ReliabilityConfig()) -> Column:
    """A smooth step from 0 at full authority to 1 at the least."""
    span = max(config.minimum_authority_noise - config.full_authority_noise, 1e-12)
    t = clamp01((col(likelihood) - config.full_authority_noise) / span)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def reliability(likelihood: Column | str, config: ReliabilityConfig = ReliabilityConfig()) -> Column:
    """What evidence under noise of this likelihood counts; 1 without noise evidence."""
    return F.coalesce(F.lit(1.0) - (1.0 - config.minimum_reliability) * taper(likelihood, config), F.lit(1.0))


def silence_threshold(floor: Column | str, config: AcousticConfig = AcousticConfig()) -> Column:
    return F.greatest(F.lit(config.silence_rms), col(floor) * config.adaptive_noise_multiplier)


def activity(rms, clip, pitch, voiced, flatness, zcr, floor, config: AcousticConfig = AcousticConfig()) -> Column:
    """silence, uncertain (clipping), voicedSpeech, noise or uncertain: the first that applies."""
    rms, clip, pitch, voiced, flatness, zcr = map(col, (rms, clip, pitch, voiced, flatness, zcr))
    flat, rough = flatness > config.maximum_speech_flatness, zcr > config.maximum_speech_zcr
    speech = pitch.isNotNull() & (voiced >= config.minimum_pitch_evidence) & ~flat & ~rough
    return F.when(rms < silence_threshold(floor, config), "silence").when(clip > config.maximum_clipping_fraction, "uncertain").when(speech, "voicedSpeech").when(flat | rough, "noise").otherwise("uncertain")


def quality(rms, clip, pitch, flatness, zcr, kind, floor, config: AcousticConfig = AcousticConfig()) -> Column:
    """struct<score, usable, issues>: what is deducted for which issue."""
    rms, clip, pitch, flatness, zcr, kind = map(col, (rms, clip, pitch, flatness, zcr, kind))
    low, clipped, unvoiced, noisy = rms < silence_threshold(floor, config), clip > config.maximum_clipping_fraction, pitch.isNull(), kind == "noise"
    less = lambda cond, by: F.when(cond, by).otherwise(F.lit(0.0))
    score = F.when(low, 0.0).otherwise(1.0)
    score = score - less(clipped, F.least(F.lit(0.6), clip * 5.0)) - less(unvoiced, F.lit(0.25)) - less(noisy, F.lit(0.4))
    score = clamp01(score - less(flatness > config.maximum_speech_flatness, F.lit(0.15)) - less(zcr > config.maximum_speech_zcr, F.lit(0.15)))
    issues = F.array_compact(F.array(F.when(low, "lowEnergy"), F.when(clipped, "clipping"), F.when(unvoiced, "unvoiced"), F.when(noisy, "noiseLike")))
    return F.struct(score.alias("score"), ((kind == "voicedSpeech") & (score >= config.minimum_profile_quality)).alias("usable"), issues.alias("issues"))
