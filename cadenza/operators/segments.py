"""Turns, change spans and speaker profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distribution as D
from ..functions import vectors as V
from .frames import elementwise
from .ordered import islands, rebased


def turns(rows: DataFrame, keys: Sequence[str], speaker: str = "resolved_speaker", confidence: str = "resolved_confidence", merge_gap: float = 0.15, order: str = "obs_id") -> DataFrame:
    """Merges neighbouring observations of one speaker: segment_index, speaker, range, confidence, observation_ids.

    The confidence is that of the observations, each counting as long as it
    lasts (1e-12 s at least), a missing one as 0.
    """
    marked = islands(rows, keys, [order], [speaker], "start_s", "end_s", merge_gap)
    weight = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(1e-12))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o")))), lambda r: r["o"])
    merged = marked.groupBy(*keys, "island").agg(F.first(speaker).alias("speaker"), F.min_by("start_s", order).alias("start_s"), F.max("end_s").alias("end_s"), (F.sum(F.coalesce(confidence, F.lit(0.0)) * weight) / F.sum(weight)).alias("confidence"), ids.alias("observation_ids"))
    return merged.select(*keys, F.col("island").alias("segment_index"), "speaker", "start_s", "end_s", "confidence", "observation_ids")


def change_spans(changes: DataFrame, keys: Sequence[str], baseline: str, replay: str, maximum_gap: float, tie: Sequence[str] = ()) -> DataFrame:
    """Merges changes with the same (baseline, replay) that follow within ``maximum_gap`` of the span so far."""
    marked = islands(changes, keys, ["start_s", "end_s", *tie], [baseline, replay], "start_s", "end_s", maximum_gap)
    spans = marked.groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first(baseline).alias("baseline_speaker"), F.first(replay).alias("replay_speaker"), F.count("*").alias("n_observations"))
    return spans.withColumnRenamed("island", "span")


def compared(baseline: DataFrame, replay: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Observations of both whose label differs, with range and both labels; observations missing in the replay are skipped."""
    b = baseline.select(*keys, "obs_id", "start_s", "end_s", F.col(label).alias("baseline_speaker"))
    r = replay.select(*keys, "obs_id", F.col(label).alias("replay_speaker"))
    return b.join(r, [*keys, "obs_id"]).where("baseline_speaker <> replay_speaker")


def weighted_moments(rows: DataFrame, keys: Sequence[str], vector: str, weight: str) -> DataFrame:
    """Weighted mean and deviation of each vector entry: centroid and dispersion of a group."""
    sized = rows.select(*keys, F.col(vector).cast("array<double>").alias("_v"), F.col(weight).cast("double").alias("_w"))
    shortest = sized.groupBy(*keys).agg(F.min(F.size("_v")).alias("_n"))
    entries = sized.select(*keys, "_w", F.posexplode("_v").alias("_i", "_x"))
    first = entries.groupBy(*keys, "_i").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.sum("_w").alias("_t"))
    means = first.select(*keys, "_i", F.when(F.col("_t") > 1e-12, F.col("_s") / F.col("_t")).otherwise(F.col("_s")).alias("_m"))
    off = (F.col("_x") - F.col("_m")) * (F.col("_x") - F.col("_m"))
    second = entries.join(means, [*keys, "_i"]).groupBy(*keys, "_i").agg(F.first("_m").alias("_m"), F.sum(F.col("_w") * off).alias("_q"), F.sum("_w").alias("_t"))
    second = second.withColumn("_d", F.when(F.col("_t") > 1e-12, F.sqrt(F.col("_q") / F.col("_t"))).otherwise(F.col("_q")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_i", c))), lambda r: r[c])
    return second.join(shortest, list(keys)).where(F.col("_i") < F.col("_n")).groupBy(*keys).agg(ordered("_m").alias("centroid"), ordered("_d").alias("dispersion"))


def embedding_profiles(rows: DataFrame, keys: Sequence[str], embedding: str, provider: str | None = None, model: str | None = None) -> DataFrame:
    """Mean direction and spread of a group's embeddings, which count by direction only.

    evidence_count, centroid (unit length), dispersion (root mean square cosine
    distance to it), and provider and model where the whole group agrees on
    one. Null centroid and dispersion where a vector has no length or another
    dimension.
    """
    e = rows.where(F.col(embedding).isNotNull()).select(*keys, F.col(embedding).cast("array<double>").alias("_e"), (F.col(provider) if provider else F.lit(None).cast("string")).alias("_p"), (F.col(model) if model else F.lit(None).cast("string")).alias("_m"))
    unit = e.withColumn("_u", V.l2_normalized("_e", single=True).cast("array<double>"))
    fine = (F.count_if(F.col("_u").isNull()) == 0) & (F.min(F.size("_e")) == F.max(F.size("_e")))
    stats = unit.groupBy(*keys).agg(F.count("*").alias("evidence_count"), fine.alias("_ok"), D.unanimous("_p").alias("provider"), D.unanimous("_m").alias("model"))
    mean = elementwise(unit.where(F.col("_u").isNotNull()), keys, "_u").select(*keys, V.l2_normalized(F.col("mean").cast("array<float>"), single=True).alias("_c"))
    model_rows = stats.join(mean, list(keys), "left").withColumn("centroid", F.when(F.col("_ok"), F.col("_c"))).drop("_ok", "_c")
    off = unit.join(model_rows.select(*keys, "centroid"), list(keys)).withColumn("_d", V.embedding_distance("_u", F.col("centroid")))
    spread = off.groupBy(*keys).agg(F.when(F.count_if(F.col("_d").isNull()) == 0, F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("dispersion"))
    return model_rows.join(spread, list(keys), "left")


def acoustic_profiles(owners: DataFrame, frames: DataFrame, keys: Sequence[str], enhanced: DataFrame | None = None) -> DataFrame:
    """Distributions over the frames of each group of ``owners`` (keys, *group, frame_ids, agreement struct)."""
    group = [c for c in owners.columns if c not in ("frame_ids", "agreement")]
    ids = owners.select(*group, F.explode("frame_ids").alias("id"))
    rows = ids.join(frames, [*keys, "id"])
    if enhanced is not None:
        rows = rows.join(enhanced.select(*keys, "id", F.col("quality_score").alias("_eq"), F.col("usable").alias("_eu")), [*keys, "id"], "left")
    else:
        rows = rows.withColumns({"_eq": F.lit(None).cast("double"), "_eu": F.lit(None).cast("boolean")})
    parts = {"rms": "rms", "pitch_hz": "pitch_hz", "pitch_confidence": "pitch_conf", "centroid_hz": "centroid_hz", "flatness": "flatness", "consistency": "consistency", "raw_quality": "quality_score", "enhanced_quality": "_eq"}
    stats = rows.groupBy(*group).agg(*[D.distribution(c).alias(n) for n, c in parts.items()], D.fraction(~F.col("usable") & F.coalesce("_eu", F.lit(False))).alias("recovered_fraction"))
    mels = elementwise(rows, group, "log_mel").select(*group, F.col("mean").alias("log_mel_mean"), F.col("dispersion").alias("log_mel_dispersion"))
    agree = owners.groupBy(*group).agg(*[D.distribution(f"agreement.{c}").alias(n) for n, c in (("view_agreement", "combined"), ("mfcc_shape_agreement", "mfcc_shape"), ("log_mel_shape_agreement", "log_mel_shape"))])
    return stats.join(mels, group, "left").join(agree, group, "left")


def speaker_profiles(rows: DataFrame, keys: Sequence[str], vector: str = "values", weight: str = "reliability") -> DataFrame:
    """Per speaker, over observations that smoothing left alone: count, duration, centroid, dispersion."""
    own = rows.where(~F.col("changed_by_continuity"))
    by = [*keys, "speaker"]
    stats = own.groupBy(*by).agg(F.count("*").alias("observation_count"), F.sum(F.col("end_s") - F.col("start_s")).alias("observed_s"))
    return stats.join(weighted_moments(own, by, vector, weight), by, "left")


def feature_contributions(vectors: DataFrame, keys: Sequence[str], vector: str, centroid: str, coordinates: str) -> DataFrame:
    """Squared distance to a centroid by (view, family, weight), and its share of the total (0 of nothing).

    ``coordinates`` is an array<struct<view, family, weight>> beside the vector's entries.
    """
    cells = F.arrays_zip(F.col(vector).cast("array<double>").alias("v"), F.col(centroid).cast("array<double>").alias("c"), F.col(coordinates).alias("k"))
    each = vectors.select(*keys, F.explode(cells).alias("z")).where("z.v is not null and z.c is not null and z.k is not null")
    off = F.col("z.v") - F.col("z.c")
    parts = each.groupBy(*keys, F.col("z.k.view").alias("view"), F.col("z.k.family").alias("family"), F.col("z.k.weight").alias("weight")).agg(F.sum(off * off).alias("squared_distance"))
    whole = F.sum("squared_distance").over(Window.partitionBy(*keys))
    return parts.withColumn("fraction", F.when(whole > 1e-12, F.col("squared_distance") / whole).otherwise(0.0))


def renumbered(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rebased(segments, keys, ["start_s", "segment_index"], "segment_index")
