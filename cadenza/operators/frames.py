"""Frame-level operators: noise floor, classes, consistency, noise evidence, reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AcousticConfig, ReliabilityConfig
from ..functions import distribution as D
from ..functions import scalars as S
from ..functions import vectors as V


def noise_floors(frames: DataFrame, keys: Sequence[str], rms: str = "rms", config: AcousticConfig = AcousticConfig()) -> DataFrame:
    """Per session: the low decile of rms by nearest rank if the high one stands out, else 0; 0 below four frames."""
    w = Window.partitionBy(*keys)
    ranked = frames.select(*keys, F.col(rms).alias("_rms"), (F.row_number().over(w.orderBy(rms)) - 1).alias("_rank"), F.count("*").over(w).alias("_n"))
    place = lambda p: F.floor((F.col("_n") - 1).cast("double") * p).cast("int")
    low = F.max(F.when(F.col("_rank") == place(0.10), F.col("_rms")))
    high = F.max(F.when(F.col("_rank") == place(0.90), F.col("_rms")))
    found = ranked.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"), F.max("_n").alias("n_frames"))
    stands_out = (F.col("n_frames") >= 4) & (F.col("_high") > F.greatest(F.lit(config.silence_rms * 2), F.col("_low") * 1.5))
    return found.select(*keys, F.when(stands_out, F.col("_low")).otherwise(F.lit(0.0)).alias("noise_floor"), "n_frames")


def mean_noise_floor(floors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Floors of several batches, each counting as often as it has frames."""
    n = F.sum("n_frames")
    return floors.groupBy(*by).agg(F.when(n > 0, F.sum(F.col("noise_floor") * F.col("n_frames")) / n).otherwise(F.lit(0.0)).alias("noise_floor"), n.alias("n_frames"))


def classified(frames: DataFrame, keys: Sequence[str], config: AcousticConfig = AcousticConfig()) -> DataFrame:
    """Adds noise_floor, activity, quality_score, usable and issues to feature rows."""
    floors = noise_floors(frames, keys, config=config).drop("n_frames")
    rows = frames.join(floors, list(keys))
    rows = rows.withColumn("activity", S.activity("rms", "clip", "pitch_hz", "voiced_prob", "flatness", "zcr", "noise_floor", config))
    rows = rows.withColumn("_q", S.quality("rms", "clip", "pitch_hz", "flatness", "zcr", "activity", "noise_floor", config))
    return rows.withColumns({"quality_score": F.col("_q.score"), "usable": F.col("_q.usable"), "issues": F.col("_q.issues")}).drop("_q")


def with_consistency(frames: DataFrame, keys: Sequence[str], order: Sequence[str], rate: Column | str) -> DataFrame:
    """Adds how each frame differs from the one before: energy_delta_db, spectral_delta, mfcc_delta, pitch_delta, consistency, transient.

    Neutral on a session's first frame and after a hole in time.
    """
    from .ordered import lag_struct

    names = ["start_s", "end_s", "rms", "centroid_hz", "spread_hz", "flatness", "mfcc", "pitch_hz"]
    rows = frames.withColumn("_p", lag_struct(names, keys, order)).withColumn("_rate", S.col(rate).cast("double"))
    p = lambda c: F.col(f"_p.{c}")
    follows = F.col("_p").isNotNull() & (F.col("start_s") <= p("end_s") + 1.0 / F.greatest(F.lit(1.0), F.col("_rate")))
    nyquist = F.greatest(F.lit(1.0), F.col("_rate") / 2.0)
    energy = F.abs(S.decibels("rms") - S.decibels(p("rms")))
    spectral = F.least(F.lit(1.0), F.abs(F.col("centroid_hz") - p("centroid_hz")) / nyquist + F.abs(F.col("spread_hz") - p("spread_hz")) / nyquist + F.abs(F.col("flatness") - p("flatness")))
    rows = rows.withColumns({"energy_delta_db": F.when(follows, energy).otherwise(0.0), "spectral_delta": F.when(follows, spectral).otherwise(0.0), "mfcc_delta": F.when(follows, V.rms_distance("mfcc", p("mfcc"))).otherwise(0.0), "pitch_delta": F.when(follows, S.semitones("pitch_hz", p("pitch_hz")))})
    change = consistency_change("energy_delta_db", "spectral_delta", "mfcc_delta", "pitch_delta")
    rows = rows.withColumn("_c", change)
    penalty = F.least(F.lit(1.0), F.col("energy_delta_db") / 18.0)
    return rows.withColumns({"consistency": 1.0 - F.col("_c"), "transient": F.least(F.lit(1.0), F.greatest(F.col("_c"), penalty * F.col("spectral_delta")))}).drop("_p", "_c", "_rate")


def consistency_change(energy: str, spectral: str, mfcc: str, pitch: str) -> Column:
    """The weighted change of a frame: energy, spectrum, cepstrum and pitch, at most 1."""
    one = F.lit(1.0)
    return F.least(one, 0.30 * F.least(one, F.col(energy) / 18.0) + 0.35 * F.col(spectral) + 0.25 * F.least(one, F.col(mfcc) / 8.0) + 0.10 * F.least(one, F.coalesce(F.col(pitch), F.lit(0.0)) / 12.0))


def elementwise(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Per group: mean and population deviation of each vector entry, up to the shortest vector's length.

    Entries become rows and are aggregated before the shuffle, so no group is collected.
    """
    sized = df.select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    shortest = sized.groupBy(*keys).agg(F.min(F.size("_v")).alias("_n"))
    each = sized.select(*keys, F.posexplode("_v").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_i", c))), lambda r: r[c])
    joined = each.join(shortest, list(keys)) if keys else each.crossJoin(F.broadcast(shortest))
    return joined.where(F.col("_i") < F.col("_n")).groupBy(*keys).agg(ordered("_m").alias("mean"), ordered("_s").alias("dispersion"))


def noise_profiles(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per session: distributions of the silent and noisy frames, and their mean log-mel spectrum."""
    quiet = frames.where(F.col("activity").isin("silence", "noise"))
    sessions = frames.select(*keys).distinct()
    stats = quiet.groupBy(*keys).agg(F.count("*").alias("n_noise"), D.distribution("rms").alias("noise_rms"), D.distribution("flatness").alias("noise_flatness"), D.distribution("consistency").alias("noise_stationarity"))
    mels = elementwise(quiet, keys, "log_mel").select(*keys, F.col("mean").alias("log_mel_mean"), F.col("dispersion").alias("log_mel_dispersion")) if "log_mel" in frames.columns else None
    out = sessions.join(stats, list(keys), "left").fillna({"n_noise": 0})
    return out.join(mels, list(keys), "left") if mels is not None else out


def noise_evidence(frames: DataFrame, profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds noise_likelihood and its six parts, each in [0, 1]; all 0 in a session without noise frames."""
    p = profiles.select(*keys, "n_noise", F.col("noise_rms.q90").alias("_rms"), F.col("noise_flatness.median").alias("_flat"), F.col("noise_stationarity.median").alias("_still"))
    rows = frames.join(p, list(keys), "left")
    ratio = F.col("rms") / F.greatest(F.col("_rms"), F.lit(1e-9))
    some = F.coalesce(F.col("n_noise") > 0, F.lit(False))
    part = {
        "noise_low_energy": 1.0 / (1.0 + ratio * ratio),
        "noise_flatness_evidence": S.clamp01(F.col("flatness") / F.greatest(F.col("_flat"), F.lit(0.05))),
        "noise_stationarity_evidence": S.clamp01(F.col("consistency") / F.greatest(F.col("_still"), F.lit(0.10))),
        "noise_pitch_unreliability": F.when(F.col("pitch_hz").isNull(), 1.0).otherwise(S.clamp01(1.0 - F.col("pitch_conf"))),
        "noise_transient": S.clamp01("transient"),
    }
    rows = rows.withColumns({k: F.when(some, c).otherwise(0.0) for k, c in part.items()})
    blend = 0.40 * F.col("noise_flatness_evidence") + 0.15 * F.col("noise_low_energy") + 0.15 * F.col("noise_stationarity_evidence") + 0.25 * F.col("noise_pitch_unreliability") + 0.05 * F.col("noise_transient")
    return rows.withColumn("noise_likelihood", F.when(some, S.clamp01(blend)).otherwise(0.0)).drop("_rms", "_flat", "_still", "n_noise")


def reliabilities(observations: DataFrame, evidence: DataFrame, keys: Sequence[str], config: ReliabilityConfig = ReliabilityConfig()) -> DataFrame:
    """Per observation: median noise likelihood of its frames, how many have one, taper and reliability."""
    ids = observations.select(*keys, "obs_id", F.explode_outer("frame_ids").alias("frame_id"))
    likelihood = evidence.select(*keys, F.col("id").alias("frame_id"), "noise_likelihood")
    met = ids.join(likelihood, [*keys, "frame_id"], "left").groupBy(*keys, "obs_id").agg(F.percentile("noise_likelihood", F.lit(0.5)).alias("noise_likelihood"), F.count("noise_likelihood").alias("n_sources"))
    return met.withColumns({"taper": F.coalesce(S.taper("noise_likelihood", config), F.lit(0.0)), "reliability": S.reliability("noise_likelihood", config)})


def standardized(df: DataFrame, keys: Sequence[str], vector: str, weight: str, name: str = "standardized") -> DataFrame:
    """Weighted standardization of each vector entry within a session, up to the shortest vector's length.

    Entries with a deviation of 1e-9 or less become 0; without any weight the
    vectors stay as they are. Adds the vector, ``means``, ``deviations`` and
    ``total_weight``.
    """
    x, w = F.col("_x"), F.col("_w")
    base = df.select(*keys, F.col(vector).cast("array<double>").alias("_v"), F.col(weight).cast("double").alias("_w"))
    shortest = base.groupBy(*keys).agg(F.min(F.size("_v")).alias("_n"), F.sum("_w").alias("total_weight"))
    entries = base.select(*keys, "_w", F.posexplode("_v").alias("_i", "_x"))
    means = entries.groupBy(*keys, "_i").agg((F.sum(x * w) / F.sum(w)).alias("_m"))
    spread = entries.join(means, [*keys, "_i"]).groupBy(*keys, "_i").agg(F.first("_m").alias("_m"), F.sqrt(F.sum(w * (x - F.col("_m")) * (x - F.col("_m"))) / F.sum(w)).alias("_s"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_i", c))), lambda r: r[c])
    model = spread.join(shortest, list(keys)).where(F.col("_i") < F.col("_n")).groupBy(*keys).agg(ordered("_m").alias("means"), ordered("_s").alias("deviations"), F.first("total_weight").alias("total_weight"))
    joined = df.join(model, list(keys), "left")
    cells = F.zip_with(F.zip_with(F.slice(F.col(vector).cast("array<double>"), F.lit(1), F.size("means")), F.col("means"), lambda a, m: a - m), F.col("deviations"), lambda d, s: F.when(s > 1e-9, d / s).otherwise(0.0))
    return joined.withColumn(name, F.when(F.col("total_weight") > 1e-12, cells).otherwise(F.col(vector).cast("array<double>")))
