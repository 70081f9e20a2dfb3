"""A second view of the samples: a gain per chunk, with telemetry.

Any enhancer can make the second view; a table of enhanced chunks is all that
later stages ask for. This one is a plain substitute: it lifts each chunk
towards a target level, by so much at most, and clips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decibels
from ..functions.vectors import bound, rms_magnitude


def enhanced_chunks(chunks: DataFrame, target_db: float = -20.0, maximum_gain_db: float = 24.0) -> DataFrame:
    """Chunk rows with louder samples, and input_rms_db, output_rms_db, gain_db of each; silence stays."""
    rows = chunks.withColumn("input_rms_db", decibels(rms_magnitude("samples")))
    quiet = F.col("input_rms_db") < -180.0
    gain = F.when(quiet, 0.0).otherwise(F.least(F.lit(maximum_gain_db), F.greatest(F.lit(0.0), F.lit(target_db) - F.col("input_rms_db"))))
    rows = rows.withColumn("gain_db", gain)
    factor = F.pow(F.lit(10.0), F.col("gain_db") / 20.0)
    louder = bound(factor, lambda f: F.transform("samples", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * f))))
    rows = rows.withColumn("samples", louder.cast("array<float>"))
    return rows.withColumn("output_rms_db", decibels(rms_magnitude("samples")))


def blocks(enhanced: DataFrame) -> DataFrame:
    """(session_id, start_s, end_s, gain_db, input_rms_db, output_rms_db) of enhanced chunks."""
    end = F.col("start_s") + F.size("samples") / F.col("sample_rate")
    return enhanced.select("session_id", "start_s", end.alias("end_s"), "gain_db", "input_rms_db", "output_rms_db")
