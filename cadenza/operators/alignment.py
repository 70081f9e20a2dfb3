"""Who said which utterance: overlap, else a bridge between two turns of one speaker, else a single near turn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AlignmentConfig
from ..functions.scalars import clamp01
from .joins import asof_join, overlap_join

#: What an unknown confidence counts.
UNKNOWN = 0.5


def _utterances(transcript: DataFrame, keys: Sequence[str]) -> DataFrame:
    return transcript.where("start_s is not null and end_s is not null").select(*keys, "utterance", F.col("start_s").alias("u_start"), F.col("end_s").alias("u_end"))


def _segments(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return segments.select(*keys, F.col("segment_index").alias("s_index"), F.col("speaker").alias("s_speaker"), F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"), F.col("confidence").alias("s_conf"))


def overlapping(transcript: DataFrame, segments: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """The speaker of the most overlap per utterance (of equal ones the least name): confidence and segments.

    The confidence is that of the speaker's segments, weighted by overlap, times
    the speaker's share of all overlap.
    """
    met = overlap_join(_utterances(transcript, keys), _segments(segments, keys), keys, ("u_start", "u_end"), ("s_start", "s_end"), width)
    by = [*keys, "utterance"]
    told = F.col("s_conf").isNotNull()
    support = met.groupBy(*by, "s_speaker").agg(F.sum("overlap_s").alias("support"), F.sum(F.when(told, F.col("s_conf") * F.col("overlap_s"))).alias("_c"), F.sum(F.when(told, F.col("overlap_s"))).alias("_w"), F.array_sort(F.collect_list("s_index")).alias("segments"))
    rank = Window.partitionBy(*by).orderBy(F.desc("support"), "s_speaker")
    total = F.sum("support").over(Window.partitionBy(*by))
    best = support.withColumn("_all", total).withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    sure = F.coalesce(F.col("_c") / F.col("_w"), F.lit(UNKNOWN))
    return best.select(*by, F.col("s_speaker").alias("speaker"), clamp01(sure * F.col("support") / F.greatest(F.col("_all"), F.lit(1e-12))).alias("confidence"), F.lit("temporalOverlap").alias("method"), "segments")


def with_neighbours(transcript: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Utterances with the segment that ends last before them and the one that begins first after them; of equals the least index."""
    u, s = _utterances(transcript, keys), _segments(segments, keys)
    values = ["s_index", "s_speaker", "s_start", "s_end", "s_conf"]
    before = asof_join(u, s, keys, "u_start", "s_end", values, [-F.col("s_index")], True, "before")
    return asof_join(before, s, keys, "u_end", "s_start", values, [-F.col("s_index")], False, "after")


def bridged(neighbours: DataFrame, keys: Sequence[str], config: AlignmentConfig = AlignmentConfig()) -> DataFrame:
    """One speaker on both sides of a gap that is not too long; the longer it is, the less sure."""
    gap = F.col("after.s_start") - F.col("before.s_end")
    near = 1.0 - 0.5 * gap / config.maximum_bridge_seconds if config.maximum_bridge_seconds > 0 else F.lit(1.0)
    sure = clamp01(F.least(F.coalesce("before.s_conf", F.lit(UNKNOWN)), F.coalesce("after.s_conf", F.lit(UNKNOWN))) * near)
    fits = (F.col("before.s_speaker") == F.col("after.s_speaker")) & (gap >= 0) & (gap <= config.maximum_bridge_seconds)
    rows = neighbours.where(fits).withColumn("confidence", sure).where(F.col("confidence") >= config.minimum_bridged_confidence)
    return rows.select(*keys, "utterance", F.col("before.s_speaker").alias("speaker"), "confidence", F.lit("bridgedGap").alias("method"), F.array("before.s_index", "after.s_index").alias("segments"))


def nearest(neighbours: DataFrame, keys: Sequence[str], config: AlignmentConfig = AlignmentConfig()) -> DataFrame:
    """The one side that is near enough; nothing if both are."""
    most = config.maximum_nearest_seconds
    d_before = F.greatest(F.lit(0.0), F.col("u_start") - F.col("before.s_end"))
    d_after = F.greatest(F.lit(0.0), F.col("after.s_start") - F.col("u_end"))
    left = F.col("before").isNotNull() & (d_before <= most)
    right = F.col("after").isNotNull() & (d_after <= most)
    rows = neighbours.withColumns({"_l": F.coalesce(left, F.lit(False)), "_r": F.coalesce(right, F.lit(False)), "_db": d_before, "_da": d_after}).where("_l <> _r")
    rows = rows.withColumn("_s", F.when(F.col("_l"), F.col("before")).otherwise(F.col("after"))).withColumn("_d", F.when(F.col("_l"), F.col("_db")).otherwise(F.col("_da")))
    near = 1.0 - F.col("_d") / most if most > 0 else F.lit(1.0)
    rows = rows.withColumn("confidence", clamp01(F.coalesce("_s.s_conf", F.lit(UNKNOWN)) * (0.5 + 0.5 * near) * 0.75)).where(F.col("confidence") >= config.minimum_nearest_confidence)
    return rows.select(*keys, "utterance", F.col("_s.s_speaker").alias("speaker"), "confidence", F.lit("nearestEvidence").alias("method"), F.array("_s.s_index").alias("segments"))


def aligned(transcript: DataFrame, segments: DataFrame, keys: Sequence[str], config: AlignmentConfig = AlignmentConfig(), width: float = 30.0) -> DataFrame:
    """The first of overlap, bridge and nearest that assigns a speaker; utterances without one, or without a range, have no row."""
    direct = overlapping(transcript, segments, keys, width)
    by = [*keys, "utterance"]
    around = with_neighbours(transcript, segments, keys)
    ways = direct.withColumn("_o", F.lit(0)).unionByName(bridged(around, keys, config).withColumn("_o", F.lit(1))).unionByName(nearest(around, keys, config).withColumn("_o", F.lit(2)))
    first = F.min_by(F.struct("speaker", "confidence", "method", "segments"), "_o").alias("a")
    return ways.groupBy(*by).agg(first).select(*by, "a.*")


def attributed(transcript: DataFrame, alignment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All utterances, with their assignment where there is one."""
    return transcript.join(alignment.withColumnRenamed("confidence", "speaker_confidence"), [*keys, "utterance"], "left")


def by_method(alignment: DataFrame, method: str) -> DataFrame:
    """The assignments that were made one way: temporalOverlap, bridgedGap or nearestEvidence."""
    return alignment.where(F.col("method") == method)
