"""Distributions as one aggregate: count, extremes, mean, median, spread and quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

QUANTILES = {"median": 0.5, "q10": 0.10, "q25": 0.25, "q75": 0.75, "q90": 0.90}
FIELDS = ("count", "minimum", "maximum", "mean", "median", "standard_deviation", "q10", "q25", "q75", "q90")


def distribution(c: Column | str) -> Column:
    """struct of FIELDS over the values that are not null; all zero without any.

    Quantiles are exact and interpolated linearly; the deviation is that of a
    population. Partial aggregates combine before the shuffle.
    """
    c = col(c).cast("double")
    q = F.percentile(c, F.array(*map(F.lit, QUANTILES.values())))
    some = lambda x: F.coalesce(x, F.lit(0.0))
    at = {name: some(F.try_element_at(q, F.lit(i + 1))) for i, name in enumerate(QUANTILES)}
    return F.struct(
        F.count(c).alias("count"),
        some(F.min(c)).alias("minimum"),
        some(F.max(c)).alias("maximum"),
        some(F.avg(c)).alias("mean"),
        at["median"].alias("median"),
        some(F.stddev_pop(c)).alias("standard_deviation"),
        *[at[k].alias(k) for k in ("q10", "q25", "q75", "q90")],
    )


def mean_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.avg(col(c)), F.lit(0.0))


def deviation_or_zero(c: Column | str) -> Column:
    """Population deviation; 0 for one value or none."""
    return F.coalesce(F.stddev_pop(col(c)), F.lit(0.0))


def fraction(condition: Column) -> Column:
    """Share of the rows that meet a condition, 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def unanimous(c: Column | str) -> Column:
    """The value if all rows have the same one, nulls counting as a value; else null."""
    c = col(c)
    return F.when((F.count_distinct(c) == 1) & (F.count_if(c.isNull()) == 0), F.max(c))
