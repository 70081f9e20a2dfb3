"""Gap-and-cap grouping of an event stream, with the group's start kept as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder
from ..sources.tables import hours

STATE = "first_s double, last_s double, group_no long"


def group_stream(rows: DataFrame, maximum_gap: float, maximum_span: float) -> DataFrame:
    """(session_id, id, group_no) of a stream of (session_id, id, start_s, end_s), ordered within a session."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, number = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        numbers = []
        for s, e in zip(rows["start_s"].tolist(), rows["end_s"].tolist(), strict=True):
            if first is None:
                first = s
            elif s - last > maximum_gap or e - first > maximum_span:
                first, number = s, number + 1
            last = e
            numbers.append(number)
        state.update((first, last, number))
        yield pd.DataFrame({"session_id": key[0], "id": rows["id"].to_numpy(), "group_no": numbers})

    return rows.groupBy("session_id").applyInPandasWithState(run, "session_id long, id long, group_no long", STATE, "append", GroupStateTimeout.NoTimeout)


def streamed_groups(spark: SparkSession, sf_dir: str, maximum_gap: float, maximum_span: float) -> DataFrame:
    """Runs the stream over the event files until all are read, and returns what it has written."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), hours().alias("start_s")).withColumn("end_s", F.col("start_s") + 0.5)
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = group_stream(rows, maximum_gap, maximum_span).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("session_id long, id long, group_no long").parquet(f"{base}/out").select("id", "group_no")
