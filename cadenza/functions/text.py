"""Text forms: fixed decimals, CSV fields, joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def _halves(x: Column) -> tuple[Column, Column]:
    """x as the sum of two doubles of 26 bits each."""
    big = x * 134217729.0
    high = big - (big - x)
    return high, x - high


def decimals(c: Column | str, places: int = 8) -> Column:
    """C's %.<places>f; null stays null.

    The JVM rounds the shortest decimal form of a double, C its exact value;
    they differ where that form ends in a 5 just beyond the places. There the
    error of x * 2 * 10^places, computed exactly from halves, says on which
    side of the tie x lies; true ties go to even.
    """
    x = col(c).cast("double")
    plain = F.format_string(f"%.{places}f", x)
    scale = float(2 * 10**places)
    twice = x * scale
    tie = 2.0 * F.floor(twice / 2.0) + 1.0
    near_tie = (F.abs(twice) < 2.0**52) & (F.abs(twice - tie) <= F.abs(twice) * 2.0**-50)
    (xh, xl), (sh, sl) = _halves(x), (float(int(scale) >> 26 << 26), float(int(scale) & (1 << 26) - 1))
    error = ((xh * sh - tie) + xh * sl + xl * sh) + xl * sl
    low = (tie - 1) / 2
    n = F.when(error < 0, low).when(error > 0, low + 1).otherwise(F.when(low % 2 == 0, low).otherwise(low + 1))
    exact = F.format_string(f"%.{places}f", n / float(10**places))
    return F.when(x.isNotNull(), F.when(near_tie, F.when((n == 0) & (x < 0), F.concat(F.lit("-"), F.replace(exact, F.lit("-"), F.lit("")))).otherwise(exact)).otherwise(plain))


def csv_number(c: Column | str, places: int = 8) -> Column:
    return F.coalesce(decimals(c, places), F.lit(""))


def csv_field(c: Column | str) -> Column:
    """Quoted only if it holds a comma, a quote or a line feed; quotes are doubled; null is empty."""
    c = F.coalesce(col(c), F.lit(""))
    special = F.contains(c, F.lit(",")) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n"))
    return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_flag(c: Column | str) -> Column:
    return F.when(F.coalesce(col(c), F.lit(False)), "1").otherwise("0")


def joined_in_order(text: Column | str, order: Column | str, separator: str = "") -> Column:
    """An aggregate: the texts of a group, in order, with nothing (or a separator) between them."""
    rows = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), F.coalesce(col(text), F.lit("")).alias("t"))))
    return F.concat_ws(separator, F.transform(rows, lambda r: r["t"]))


def optional_decimals(c: Column | str, places: int = 3) -> Column:
    return F.coalesce(decimals(c, places), F.lit("n/a"))
