"""Transcripts as tables: utterance rows from any recogniser's output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import time_range
from ..functions.text import joined_in_order
from ..operators.ordered import rebased


def transcript(rows: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "segment_index") -> DataFrame:
    """(keys, utterance, text, start_s, end_s, confidence, alternatives, is_final) of rows with a start and a duration.

    Missing columns get their neutral value; a time that is not finite leaves
    the utterance without a range, and it stays.
    """
    have = set(rows.columns)
    given = lambda c, other: F.col(c) if c in have else other
    span = time_range("start_s", "duration_s")
    out = rebased(rows.withColumn("_r", span), keys, [order], "utterance")
    return out.select(
        *keys,
        "utterance",
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("_r.start_s").alias("start_s"),
        F.col("_r.end_s").alias("end_s"),
        given("confidence", F.lit(None)).cast("double").alias("confidence"),
        F.coalesce(given("alternatives", F.lit(None)).cast("array<string>"), F.expr("cast(array() as array<string>)")).alias("alternatives"),
        F.coalesce(given("is_final", F.lit(True)), F.lit(True)).alias("is_final"),
    )


def whole_text(rows: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session, all utterances' texts in order with nothing between them."""
    return rows.groupBy(*keys).agg(joined_in_order("text", "utterance").alias("text"))
