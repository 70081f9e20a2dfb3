"""Operators over the rows of a session in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """Feeds each session's rows, in order, to a function that keeps a constant-size state.

    Sessions are dealt by ``keys`` and sorted by Spark, which spills; the
    function sees Arrow batches of a partition, one session after another, so
    no session is ever held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = step()
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def capped_gap_groups(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], maximum_gap: float, maximum_span: float, name: str = "group_no") -> DataFrame:
    """Numbers the groups of each session: a row opens one if it begins more than
    ``maximum_gap`` after the last row's end, or would stretch the group beyond
    ``maximum_span`` from the group's own start.

    The second rule depends on where the group began, so a lag and a running sum
    cannot express it; the scan carries the group's start, the last end and a
    counter. Rows without a start or end are left out.
    """
    fine = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    columns = fine.columns
    at = {c: i for i, c in enumerate(columns)}

    def step():
        state: dict = {"key": None}

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            key_rows = list(zip(*(b.column(at[k]).to_pylist() for k in keys), strict=True))
            out, key = [], state["key"]
            first, last, number = state.get("first", 0.0), state.get("last", 0.0), state.get("number", 0)
            for k, s, e in zip(key_rows, b.column(at[start]).to_pylist(), b.column(at[end]).to_pylist(), strict=True):
                if k != key:
                    key, first, number = k, s, 0
                elif s - last > maximum_gap or e - first > maximum_span:
                    first, number = s, number + 1
                last = e
                out.append(number)
            state.update(key=key, first=first, last=last, number=number)
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*columns, name])

        return batch

    schema = T.StructType([*fine.schema.fields, T.StructField(name, T.LongType())])
    return scan_sorted(fine, keys, order, step, schema)


def grouped_spans(groups: DataFrame, keys: Sequence[str], start: str, end: str, group: str = "group_no", minimum_span: float = 0.0, *aggregates: Column) -> DataFrame:
    """One row per group of ``capped_gap_groups`` that lasts long enough, numbered again from 0 (``obs_id``).

    A group lasts from its first row's start to its last row's end.
    """
    rows = groups.groupBy(*keys, group).agg(F.min(start).alias("start_s"), F.max_by(end, F.struct(start, end)).alias("end_s"), F.count("*").alias("n_rows"), *aggregates)
    kept = rows.where(F.col("end_s") - F.col("start_s") >= minimum_span)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(group)) - 1
    return kept.withColumn("obs_id", number.cast("long"))


def rebased(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Dense ids from 0 in the given order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str], start: str, end: str, maximum_gap: float, name: str = "island") -> DataFrame:
    """Numbers maximal runs of rows that agree in ``same`` and follow each other within ``maximum_gap``.

    The gap is measured from the greatest end so far, and may be negative
    (overlap). Two windows and two running sums; nothing is collected.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    turn = F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(differs.cast("int"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    turns = df.withColumn("_turn", turn)
    inside = Window.partitionBy(*keys, "_turn").orderBy(*order)
    reached = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col(start) - reached > maximum_gap), 1).otherwise(0)
    broken = turns.withColumn("_fresh", fresh)
    number = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return broken.withColumn(name, (number - 1).cast("long")).drop("_turn", "_fresh")


def lag_struct(columns: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> Column:
    """The previous row's columns, null on a session's first row."""
    return F.lag(F.struct(*columns)).over(Window.partitionBy(*keys).orderBy(*order))
