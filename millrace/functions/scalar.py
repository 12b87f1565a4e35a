"""Scalar functions over columns: names, hashes, numbers, addresses, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.semantics import power_of_two


def pascal_case(c: Column) -> Column:
    """UPPER_SNAKE to PascalCase."""
    return F.array_join(F.transform(F.split(F.lower(c), "_"), lambda w: F.initcap(w)), "")


def short_hash(c: Column, chars: int = 16, kind: str = "sha256") -> Column:
    """The first hex characters of a digest."""
    return F.substring(F.md5(c) if kind == "md5" else F.sha2(c, 256), 1, chars)


def parse_int(c: Column) -> Column:
    """Decimal or 0x text to a bigint; signs and u/l suffixes allowed; null for anything else."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[ul]+$", "")
    negative = s.startswith("-")
    digits = F.regexp_replace(s, "^[+-]", "")
    hexed = F.regexp_extract(digits, "^0x([0-9a-f]{1,15})$", 1)
    value = F.when(hexed != "", F.conv(F.when(hexed != "", hexed), 16, 10).try_cast("bigint")).otherwise(F.when(digits.rlike("^[0-9]+$"), digits).try_cast("bigint"))
    return F.when(negative, -value).otherwise(value)


def hex_address(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def to_address(rva: Column, image_base: int) -> Column:
    return F.lit(image_base) + rva


def to_rva(address: Column, image_base: int) -> Column:
    return address - F.lit(image_base)


def normalise_code(c: Column) -> Column:
    """Pseudocode without comments, with variables and literals collapsed and white space squeezed."""
    for pattern, by in [(r"(?s)/\*.*?\*/", " "), (r"//[^\n]*", " "), (r'"(?:[^"\\]|\\.)*"', "STR"), (r"\b0x[0-9a-fA-F]+\b", "NUM"), (r"\b\d+\b", "NUM"), (r"\b[av]\d+\b", "VAR"), (r"\s+", " ")]:
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def flag_count(c: Column) -> Column:
    return F.bit_count(c)


def is_flag(c: Column) -> Column:
    return power_of_two(c)


def compare(left: Column, op: Column, right: Column) -> Column:
    """Evaluate an operator given as text. Sides are compared as numbers if both are, else as text for (in)equality; an unknown operator is true, an ordering of text false."""
    a, b = left.cast("string").try_cast("double"), right.cast("string").try_cast("double")
    numeric = a.isNotNull() & b.isNotNull()
    ordered = lambda x: F.when(numeric, x).otherwise(F.lit(False))
    equal = F.when(numeric, a == b).otherwise(left.cast("string") == right.cast("string"))
    return (
        F.when(op.isin("=", "=="), equal).when(op.isin("!=", "<>"), ~equal)
        .when(op == "<", ordered(a < b)).when(op == "<=", ordered(a <= b)).when(op == ">", ordered(a > b)).when(op == ">=", ordered(a >= b))
        .otherwise(F.lit(True))
    )


def in_daily_window(minute: Column, start: int, end: int) -> Column:
    """Whether a minute of the day lies in a daily window, which may cross midnight."""
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def minutes_until(minute: Column, start: int) -> Column:
    return F.pmod(F.lit(start) - minute, F.lit(1440))


def remap(df: DataFrame, offsets: DataFrame, families: DataFrame, *, key: str = "family", index: str = "idx", out: str = "mapped", most: int = 100_000) -> DataFrame:
    """Values moved by their family's shift plus the piecewise offset in force at their index.

    families: key, shift. offsets: key, index_from, offset (null: undecided). The offset in force is that of the largest index_from not above
    the index, 0 before the first; null whenever the family or its offset isn't known. The breakpoints become intervals, so rows need no
    order and no family gathers in a task; up to `most` of them come as a broadcast.
    """
    spans = offsets.select(key, F.col("index_from").alias("__from"), F.lead("index_from").over(Window.partitionBy(key).orderBy("index_from")).alias("__to"), F.col("offset").alias("__offset"), F.lit(True).alias("__in"))
    if offsets.count() <= most:
        spans = F.broadcast(spans)
    a, b = df.alias("a"), spans.alias("b")
    inside = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{index}") >= F.col("b.__from")) & (F.col("b.__to").isNull() | (F.col(f"a.{index}") < F.col("b.__to")))
    rows = a.join(b, inside, "left").select("a.*", "__in", "__offset").join(families.select(key, F.col("shift").alias("__shift")), key, "left")
    value = F.col(index) + F.col("__shift") + F.when(F.col("__in"), F.col("__offset")).otherwise(F.lit(0))
    return rows.withColumn(out, value).drop("__in", "__offset", "__shift")
