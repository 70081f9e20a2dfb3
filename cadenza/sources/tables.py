"""Domain tables out of generic ones.

No table of recordings is at hand, so events stand in: a user is a session, an
event a frame, an hour the unit of time, and value and k give its features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["session_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: str = "ts"):
    """Hours since 2024 began, of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts})") / F.lit(3.6e9)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(-?[0-9.]+)", 1).cast("double")
    e = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), "event_type", "value", k.alias("k"), hours().alias("start_s"))
    spoken = F.col("event_type").isin("view", "click", "signup")
    return e.select(
        "session_id",
        "id",
        "event_type",
        "value",
        "k",
        "start_s",
        (F.col("start_s") + 0.5).alias("end_s"),
        (F.col("value") / 100).alias("rms"),
        (F.col("value") / 50).alias("peak"),
        ((F.col("k") % 10) / 20).alias("zcr"),
        F.when(F.col("event_type") == "error", F.col("value") / 5000).otherwise(0.0).alias("clip"),
        F.when(spoken, 80 + F.col("k") * 3).alias("pitch_hz"),
        (1 - F.col("k") / 200).alias("pitch_conf"),
        (F.col("k") / 100).alias("voiced_prob"),
        (F.col("value") * 10).alias("centroid_hz"),
        (F.col("k") * 20).alias("spread_hz"),
        (F.col("k") / 100).alias("flatness"),
        F.array(F.col("value") / 10, F.col("k") / 10).alias("mfcc"),
        F.array(F.log(F.col("value") + 1), F.col("k") / 50).alias("log_mel"),
    )


#: The same table in DuckDB SQL.
EVENT_FRAMES_SQL = """f as (select *, start_s + 0.5 as end_s, value / 100 as rms, value / 50 as peak, (k % 10) / 20 as zcr,
  case when event_type = 'error' then value / 5000 else 0.0 end as clip,
  case when event_type in ('view', 'click', 'signup') then 80 + k * 3 end as pitch_hz, 1 - k / 200 as pitch_conf, k / 100 as voiced_prob,
  value * 10 as centroid_hz, k * 20 as spread_hz, k / 100 as flatness, [value / 10, k / 10] as mfcc, [ln(value + 1), k / 50] as log_mel
  from (select user_id as session_id, event_id as id, event_type, value, regexp_extract(props, '(-?[0-9.]+)', 1)::double as k,
    date_diff('microsecond', timestamp '2024-01-01', ts) / 3.6e9 as start_s from events))"""


def event_turns(frames: DataFrame) -> DataFrame:
    """Some events as turns of three hours; the type is the speaker."""
    rows = frames.where(F.col("event_type") != "purchase")
    return rows.select("session_id", F.col("id").alias("segment_index"), F.col("event_type").alias("speaker"), "start_s", (F.col("start_s") + 3.0).alias("end_s"), F.when(F.col("k") >= 10, F.col("k") / 100).alias("confidence"))


def event_utterances(frames: DataFrame) -> DataFrame:
    """The others as utterances of an hour and a half."""
    rows = frames.where(F.col("event_type") == "purchase")
    return rows.select("session_id", F.col("id").alias("utterance"), "start_s", (F.col("start_s") + 1.5).alias("end_s"))


TURNS_SQL = """seg as (select session_id, id as segment_index, event_type as speaker, start_s as s_start, start_s + 3.0 as s_end, case when k >= 10 then k / 100 end as conf from f where event_type <> 'purchase'),
utt as (select session_id, id as utterance, start_s as u_start, start_s + 1.5 as u_end from f where event_type = 'purchase')"""
