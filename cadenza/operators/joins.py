"""Joins that SQL has no word for: interval overlap, as-of, nearest before and after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: How much wider the buckets of each level are than those of the one before, and how many levels there are.
STEP, LEVELS = 256, 4


def _dealt(df: DataFrame, start: str, end: str, width: float, side: str) -> DataFrame:
    """A row for every bucket of a range's own level, and for those it touches on the levels above.

    The own level is the first on which the range is no longer than STEP
    buckets (the last one has no such bound).
    """
    length = F.col(end) - F.col(start)
    own = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        own = F.when(length <= width * STEP ** (k + 1), k).otherwise(own)
    levels = F.transform(F.sequence(own, F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), (F.lit(float(width)) * F.pow(F.lit(float(STEP)), k)).alias("width")))
    rows = df.withColumn(f"_{side}own", own).withColumn("_l", F.explode(levels))
    first, last = (F.floor(F.col(c) / F.col("_l.width")).cast("long") for c in (start, end))
    rows = rows.withColumn(f"_{side}first", first).withColumn("_b", F.explode(F.sequence(first, last)))
    return rows.withColumn("_k", F.col("_l.level")).drop("_l")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows of a session whose half-open ranges share more than a point, with ``overlap_s``.

    Both sides are dealt to time buckets of ``width`` and joined on session and
    bucket, so a long session is many tasks; a pair that shares several buckets
    is kept in the first they share. Longer rows are dealt to wider buckets, and
    a pair meets on the level of its longer row, so a row has some 260 copies at
    most, however long it is: choose a width of the order of the usual durations.
    Column names other than the keys must differ. Null ranges meet nothing.
    """
    (ls, le), (rs, re) = left_range, right_range
    a = _dealt(left.where(F.col(le) >= F.col(ls)), ls, le, width, "l")
    b = _dealt(right.where(F.col(re) >= F.col(rs)), rs, re, width, "r")
    overlap = F.least(le, re) - F.greatest(ls, rs)
    met = a.join(b, [*keys, "_k", "_b"]).where((F.col("_k") == F.greatest("_lown", "_rown")) & (F.col("_b") == F.greatest("_lfirst", "_rfirst"))).withColumn("overlap_s", overlap)
    return met.where("overlap_s > 0").drop("_k", "_b", "_lown", "_rown", "_lfirst", "_rfirst")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], right_order: Sequence[Column] = (), backward: bool = True, name: str = "asof") -> DataFrame:
    """Adds to each left row the struct ``name`` of the right row nearest before (or after) it, equal times included.

    A tagged union, one sort and a running last value: no range join, no
    candidates. Of right rows at the same time the last in ``right_order`` is
    taken. Null keys or times find nothing.
    """
    picked = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias(name), *[c.alias(f"_o{i}") for i, c in enumerate(right_order)])
    rows = F.struct(*left.columns)
    asked = left.select(*keys, F.col(left_time).cast("double").alias("_t"), F.lit(1).alias("_side"), rows.alias("_row"))
    both = asked.unionByName(picked, allowMissingColumns=True)
    time = F.col("_t").asc_nulls_first() if backward else F.col("_t").desc_nulls_first()
    w = Window.partitionBy(*keys).orderBy(time, "_side", *[f"_o{i}" for i in range(len(right_order))]).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_row.*", F.when(F.col("_t").isNotNull(), F.col(name)).alias(name))


def covering_block(rows: DataFrame, blocks: DataFrame, keys: Sequence[str], time: str, block_range: tuple[str, str], value: str, name: str) -> DataFrame:
    """Adds ``value`` of the last block that begins at or before ``time``, if the time is within it; else null.

    Blocks of a session follow each other; blocks without a range are left out.
    """
    start, end = block_range
    found = asof_join(rows, blocks.where(F.col(start).isNotNull()), keys, time, start, [start, end, value], [F.col(end)], name="_block")
    inside = (F.col(time) >= F.col(f"_block.{start}")) & (F.col(time) < F.col(f"_block.{end}"))
    return found.withColumn(name, F.when(inside, F.col(f"_block.{value}"))).drop("_block")


def usable_in_either(raw: DataFrame, enhanced: DataFrame, keys: Sequence[str], usable: str = "usable") -> DataFrame:
    """Rows of the raw view that are usable there or in the enhanced view of the same id."""
    other = enhanced.select(*keys, F.col(usable).alias("_other"))
    joined = raw.join(other, list(keys), "left")
    return joined.where(F.coalesce(F.col(usable), F.lit(False)) | F.coalesce(F.col("_other"), F.lit(False))).drop("_other")


def through_ids(owners: DataFrame, ids: str, rows: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Joins owners to rows through an array of row ids; ids without a row are skipped."""
    return owners.withColumn(row_id, F.explode(ids)).join(rows, [*keys, row_id])


def set_difference_count(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys of ``a`` are not in ``b``."""
    left = a.select(*keys).distinct()
    return left.join(b.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("n_difference"))


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def same_sets(df: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Per group, whether the two columns hold the same set of values."""
    return df.groupBy(*keys).agg((F.array_sort(F.collect_set(a)) == F.array_sort(F.collect_set(b))).alias("same"))
