"""Speaker observations: groups of usable frames and their weighted feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeatureWeights, GroupingConfig
from ..functions import vectors as V
from .ordered import capped_gap_groups, grouped_spans

COORDINATES = "array<struct<view:string,family:string,weight:double>>"


def grouped_frames(usable: DataFrame, keys: Sequence[str], config: GroupingConfig = GroupingConfig()) -> tuple[DataFrame, DataFrame]:
    """(observations: keys, obs_id, start_s, end_s, frame_ids; members: keys, obs_id, id)."""
    groups = capped_gap_groups(usable.select(*keys, "id", "start_s", "end_s"), keys, "start_s", "end_s", ["id"], config.maximum_gap_seconds, config.maximum_seconds)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("id"))), lambda r: r["id"]).alias("frame_ids")
    observations = grouped_spans(groups, keys, "start_s", "end_s", "group_no", config.minimum_seconds, ids)
    observations = observations.select(*keys, "obs_id", "start_s", "end_s", "frame_ids")
    return observations, observations.select(*keys, "obs_id", F.explode("frame_ids").alias("id"))


def _deviation(x: Column) -> Column:
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def view_features(members: DataFrame, keys: Sequence[str], rate: str = "sample_rate") -> DataFrame:
    """Per observation the feature families of one view, in their order, as ``families``: array<struct<family, values>>.

    Cepstrum means and deviations, log-mel means, pitch (octaves above 100 Hz
    of the median; spread), spectral means by rate, dynamics, consistency,
    quality. Vector entries are aggregated as rows, scalars in one pass.
    """
    by = [*keys, "obs_id"]
    scale = F.greatest(F.lit(1.0), F.max(rate).cast("double"))
    pitch = F.percentile("pitch_hz", F.lit(0.5))
    one = members.groupBy(*by).agg(
        F.array(F.when(pitch > 0, F.log2(pitch / 100.0)).otherwise(0.0), _deviation(F.col("pitch_hz")) / 200.0).alias("pitch"),
        F.array(*[F.avg(c) / scale for c in ("centroid_hz", "spread_hz", "rolloff_hz")], F.avg("flatness") / scale).alias("spectral"),
        F.array(F.avg("rms"), F.avg("zcr")).alias("dynamics"),
        F.array(F.avg("consistency"), F.avg("transient")).alias("consistency"),
        F.array(F.avg("quality_score")).alias("quality"),
    )
    cells = members.select(*by, F.explode(F.array(F.struct(F.lit("mfcc").alias("f"), F.col("mfcc").alias("v")), F.struct(F.lit("logMel").alias("f"), F.col("log_mel").alias("v")))).alias("z"))
    shortest = cells.groupBy(*by, "z.f").agg(F.min(F.size("z.v")).alias("n"))
    each = cells.select(*by, "z.f", F.posexplode("z.v").alias("i", "x")).groupBy(*by, "f", "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    each = each.join(shortest, [*by, "f"]).where("i < n")
    values = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda r: r[c])
    long = each.groupBy(*by, "f").agg(values("m").alias("m"), values("s").alias("s"))
    wide = long.groupBy(*by).agg(F.max(F.when(F.col("f") == "mfcc", F.concat("m", "s"))).alias("mfcc"), F.max(F.when(F.col("f") == "logMel", F.col("m"))).alias("logMel"))
    joined = one.join(wide, by, "left")
    none = F.lit(None).cast("array<double>")
    order = ["mfcc", "logMel", "pitch", "spectral", "dynamics", "consistency", "quality"]
    return joined.select(*by, F.array(*[F.struct(F.lit(f).alias("family"), F.coalesce(F.col(f), F.coalesce(none, F.array().cast("array<double>"))).alias("values")) for f in order]).alias("families"))


def family_weight(weights: FeatureWeights) -> Column:
    """map family -> configured weight."""
    return F.create_map(*[x for f in ("mfcc", "logMel", "pitch", "spectral", "dynamics", "consistency", "quality") for x in (F.lit(f), F.lit(float(max(0.0, getattr(weights, f)))))])


def feature_vector(families: str, view: str, weights: FeatureWeights) -> tuple[Column, Column]:
    """(values, coordinates) of one view: each coordinate has its family's weight, in the enhanced view scaled down."""
    factor = weights.enhancedView if view == "enhanced" else 1.0
    values = F.flatten(F.transform(families, lambda f: f["values"]))
    coordinates = F.flatten(F.transform(families, lambda f: F.transform(f["values"], lambda _: F.struct(F.lit(view).alias("view"), f["family"].alias("family"), (F.try_element_at(family_weight(weights), f["family"]) * F.lit(float(max(0.0, factor)))).alias("weight")))))
    return values, coordinates


def weight_settings(weights: FeatureWeights, weighting: str = "perCoordinate") -> Column:
    """struct<families, enhanced, shared>: settings that ``reweighted`` reads, so that rows may differ in them."""
    return F.struct(family_weight(weights).alias("families"), F.lit(float(weights.enhancedView)).alias("enhanced"), F.lit(weighting == "normalizedFamily").alias("shared"))


def reweighted(coordinates: str, settings: Column) -> Column:
    """Coordinates with new family weights: all of it each, or shared by a view's coordinates of a family."""

    def one(c: Column) -> Column:
        n = F.size(F.filter(coordinates, lambda o: (o["view"] == c["view"]) & (o["family"] == c["family"])))
        share = F.when(settings["shared"], F.greatest(n, F.lit(1)).cast("double")).otherwise(1.0)
        view = F.when(c["view"] == "enhanced", settings["enhanced"]).otherwise(1.0)
        return F.struct(c["view"].alias("view"), c["family"].alias("family"), (F.try_element_at(settings["families"], c["family"]) * view / share).alias("weight"))

    return F.transform(coordinates, one)


def view_agreement(members: DataFrame, enhanced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per observation: how alike the two views' shapes are, struct<mfcc_shape, log_mel_shape, combined>."""
    other = enhanced.select(*keys, "id", F.col("mfcc").alias("_m"), F.col("log_mel").alias("_l"))
    both = members.join(other, [*keys, "id"])
    tail = lambda c: F.slice(F.col(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    rows = both.withColumns({"_a": V.cosine_agreement(tail("mfcc"), tail("_m")), "_b": V.cosine_agreement(V.centered("log_mel"), V.centered("_l"))})
    means = rows.groupBy(*keys, "obs_id").agg(F.avg("_a").alias("mfcc_shape"), F.avg("_b").alias("log_mel_shape"))
    return means.select(*keys, "obs_id", F.struct("mfcc_shape", "log_mel_shape", ((F.col("mfcc_shape") + F.col("log_mel_shape")) / 2).alias("combined")).alias("agreement"))


def observations(frames: DataFrame, keys: Sequence[str], config: GroupingConfig = GroupingConfig(), enhanced: DataFrame | None = None) -> DataFrame:
    """obs_id, range, frame_ids, values, weights, coordinates, quality_score, agreement of each group of usable frames.

    A frame counts if either view finds it usable. The enhanced view adds its
    own dimensions where it has frames of the group, so vectors may differ in
    length; later stages use the shared dimensions.
    """
    from .joins import usable_in_either

    by = [*keys, "obs_id"]
    usable = usable_in_either(frames, enhanced, [*keys, "id"]) if enhanced is not None else frames.where("usable")
    obs, ids = grouped_frames(usable, keys, config)
    members = ids.join(frames, [*keys, "id"])
    values, coordinates = feature_vector("families", "raw", config.weights)
    out = view_features(members, keys).select(*by, values.alias("values"), coordinates.alias("coordinates"))
    score = F.col("quality_score")
    if enhanced is not None:
        twins = ids.join(enhanced, [*keys, "id"])
        v2, c2 = feature_vector("families", "enhanced", config.weights)
        more = view_features(twins, keys).select(*by, v2.alias("_v"), c2.alias("_c"))
        out = out.join(more, by, "left").select(*by, F.concat("values", F.coalesce("_v", F.array().cast("array<double>"))).alias("values"), F.concat("coordinates", F.coalesce("_c", F.array().cast(COORDINATES))).alias("coordinates"))
        members = members.join(enhanced.select(*keys, "id", F.col("quality_score").alias("_eq")), [*keys, "id"], "left")
        score = F.greatest(F.col("quality_score"), F.coalesce("_eq", F.lit(0.0)))
    quality = members.groupBy(*by).agg(F.avg(score).alias("quality_score"))
    out = obs.join(out, by).join(quality, by)
    if enhanced is not None:
        out = out.join(view_agreement(members.drop("_eq"), enhanced, keys), by, "left")
    else:
        out = out.withColumn("agreement", F.lit(None).cast("struct<mfcc_shape:double,log_mel_shape:double,combined:double>"))
    return out.withColumn("weights", F.transform("coordinates", lambda c: c["weight"]))


def family_counts(observation_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coordinates of each observation by view and family."""
    each = observation_rows.select(*keys, F.explode("coordinates").alias("c")).select(*keys, "c.*")
    return each.groupBy(*keys, "view", "family").agg(F.count("*").alias("n_coordinates"), F.sum("weight").alias("weight"))

