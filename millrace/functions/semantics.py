"""Rules that differ between engines, decided once.

Pattern search is case-insensitive; rounding is half-even; ratios guard their denominator; 0, "" and empty arrays count as missing where
a rule says so; ties are broken by the natural key, ascending.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ilike_any(columns: list[str | Column], patterns: list[str]) -> Column:
    """True where any column matches any pattern, ignoring case; null columns don't match."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(or_, (F.coalesce(c.ilike(p), F.lit(False)) for c in cols for p in patterns))


def contains_any(column: Column, keywords: list[str]) -> Column:
    """True where the upper-cased column holds any of the keywords."""
    up = F.upper(column)
    return reduce(or_, (F.coalesce(up.contains(k.upper()), F.lit(False)) for k in keywords))


def falsy(c: Column, kind: str) -> Column:
    """Null, or the empty value of a kind: number, string or array."""
    empty = {"number": c == 0, "string": c == "", "array": F.size(c) == 0}[kind]
    return c.isNull() | empty


def or_default(c: Column, default, kind: str) -> Column:
    """c, or default where c is falsy."""
    return F.when(falsy(c, kind), default).otherwise(c)


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / max(b, 1)."""
    x = a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))
    return x if digits is None else F.bround(x, digits)


def power_of_two(c: Column) -> Column:
    return (c > 0) & (c.bitwiseAND(c - 1) == 0)


def money(c: Column) -> Column:
    """A double of two decimals as an exact decimal, so that sums don't depend on their order."""
    return c.cast("decimal(18,2)")


def exact_sum(c: Column) -> Column:
    return F.sum(money(c)).cast("double")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in an order that the caller makes total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def upper_median(column: str) -> Column:
    """The middle of the sorted values, the upper one of an even number; not interpolated. Counts by value, so that copies cost nothing."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")
