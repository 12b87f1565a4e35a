"""Column profiles, inferred enumerations and coverage, in one pass over unpivoted columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import power_of_two


def unpivot(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """column, value for every row and column."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def value_counts(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """column, value, n: pre-aggregated, so that a profile's distinct counts cost one shuffle of distinct values."""
    return unpivot(df, columns, kind).groupBy("column", "value").agg(F.count("*").alias("n"))


def numeric(df: DataFrame, columns: list[str], top: int = 10, samples: int = 20) -> DataFrame:
    """Profile of number columns: total, nulls, min, max, distinct, zeros, is_integer, is_enum, is_flags, top values and the smallest samples.

    is_enum: 2 to 64 values and fewer than 0.3 of the total. is_flags: integers of which 0.6 are powers of two, two of them at least, or whose
    bits joined are 2 to 16 and fewer than the distinct values, below 65536.
    """
    from millrace.functions.semantics import top_n

    v = value_counts(df, columns, "double")
    whole = F.col("value") == F.floor("value")
    safe = F.when(whole & (F.abs("value") < 2.0**53), F.col("value")).cast("bigint")
    x = F.col("value").isNotNull()
    g = v.withColumn("i", safe).groupBy("column").agg(
        F.sum("n").alias("total"), F.sum(F.when(~x, F.col("n")).otherwise(0)).alias("nulls"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("distinct"),
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.bool_and(F.when(x, whole)).alias("is_integer"),
        F.count_if(power_of_two(F.col("i"))).alias("pow2"), F.count_if(F.col("i") > 0).alias("positive"), F.bit_count(F.bit_or("i")).alias("bits"),
    )
    enum = F.col("distinct").between(2, 64) & (F.col("distinct") < 0.3 * (F.col("total") - F.col("nulls")))
    flags = F.coalesce(F.col("is_integer"), F.lit(False)) & (F.col("min") >= 0) & (((F.col("pow2") >= 2) & (F.col("pow2") >= 0.6 * F.col("positive"))) | (F.col("bits").between(2, 16) & (F.col("bits") < F.col("distinct")) & (F.col("max") < 65536)))
    tops = top_n(v.where("value IS NOT NULL"), ["column"], top, F.desc("n"), F.col("value")).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("t")).select("column", F.col("t.value").alias("top_values"), F.col("t.n").alias("top_counts"))
    least = top_n(v.where("value IS NOT NULL"), ["column"], samples, F.col("value")).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return g.select("column", "total", "nulls", "min", "max", "distinct", "zeros", "is_integer", enum.alias("is_enum"), F.coalesce(flags, F.lit(False)).alias("is_flags")).join(tops, "column", "left").join(least, "column", "left")


def string(df: DataFrame, columns: list[str]) -> DataFrame:
    """Profile of text columns: total, distinct, avg and max length, empties, and a class: filepath, description or name."""
    v = value_counts(df, columns, "string").where("value IS NOT NULL")
    n = F.sum("n")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / n
    path = share(F.col("value").rlike(r"[/\\.]"))
    long_ = share(F.length("value") > 80)
    return v.groupBy("column").agg(n.alias("total"), F.count("*").alias("distinct"), F.round(F.sum(F.length("value") * F.col("n")) / n, 6).alias("avg_length"), F.max(F.length("value")).alias("max_length"), F.sum(F.when(F.col("value") == "", F.col("n")).otherwise(0)).alias("empty"), F.when(path > 0.5, "filepath").when(long_ > 0.3, "description").otherwise("name").alias("kind"))


def array(df: DataFrame, columns: list[str]) -> DataFrame:
    """Profile of array columns: max_length, distinct arrays."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.select(F.col(c).alias("a")).groupBy("a").agg(F.count("*").alias("n")).agg(F.lit(c).alias("column"), F.max(F.size("a")).alias("max_length"), F.count("a").alias("distinct"), F.sum("n").alias("total")) for c in columns])


def enums(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, members, min, max, kind, width: flags (0.6 of the positive values are powers of two), sequential (begins at 0..5 and fills half of its range) or sparse; the narrowest integer type."""
    v = values.select(key, F.col(value).cast("bigint").alias("v")).where("v IS NOT NULL").distinct()
    g = v.groupBy(key).agg(F.count("*").alias("members"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(power_of_two(F.col("v"))).alias("p"), F.count_if(F.col("v") > 0).alias("pos"))
    kind = F.when((F.col("pos") >= 2) & (F.col("p") >= 0.6 * F.col("pos")), "flags").when(F.col("min").between(0, 5) & (F.col("members") >= 0.5 * (F.col("max") - F.col("min") + 1)), "sequential").otherwise("sparse")
    width = F.lit(None).cast("string")
    for bits in (64, 32, 16, 8):
        width = F.when((F.col("min") >= 0) & (F.col("max") < (1 << bits if bits < 64 else (1 << 63) - 1)), f"uint{bits}").when((F.col("min") >= -(1 << bits - 1)) & (F.col("max") < (1 << bits - 1 if bits < 64 else (1 << 63) - 1)), f"int{bits}").otherwise(width)
    return g.select(key, "members", "min", "max", kind.alias("kind"), width.alias("width"))


def feature_prevalence(df: DataFrame, features: dict, by: str) -> DataFrame:
    """by, feature, n, frequency: how often boolean features hold, in each class."""
    pairs = F.array(*(F.struct(F.lit(name).alias("feature"), F.coalesce(cond, F.lit(False)).alias("has")) for name, cond in features.items()))
    return df.select(by, F.explode(pairs).alias("p")).groupBy(by, F.col("p.feature").alias("feature")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("p.has").cast("int")), 6).alias("frequency"))


def missing_features(df: DataFrame, key: str, features: dict, by: str, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """key, feature, expected: features that a row lacks though its class (of `least` members) or the whole has them at a frequency of threshold or more."""
    pairs = F.array(*(F.struct(F.lit(name).alias("feature"), F.coalesce(cond, F.lit(False)).alias("has")) for name, cond in features.items()))
    long = df.select(key, by, F.explode(pairs).alias("p")).select(key, by, "p.feature", "p.has")
    cls = long.groupBy(by, "feature").agg(F.count("*").alias("n"), F.avg(F.col("has").cast("int")).alias("f"))
    glob = cls.groupBy("feature").agg((F.sum(F.col("f") * F.col("n")) / F.sum("n")).alias("g"))
    freq = cls.withColumn("f", F.when(F.col("n") >= least, F.col("f")).otherwise(0.0)).join(glob, "feature").select(by, "feature", F.least(F.lit(1.0), F.greatest("f", "g")).alias("expected"))
    return long.where("NOT has").join(freq.where(F.col("expected") >= threshold), [by, "feature"]).select(key, "feature", F.round("expected", 6).alias("expected"))


def coverage(df: DataFrame, flags: list[str]) -> DataFrame:
    """source, covered, total, pct (one decimal): how many rows each flag covers."""
    pairs = F.array(*(F.struct(F.lit(c).alias("source"), F.coalesce(F.col(c), F.lit(False)).alias("has")) for c in flags))
    return df.select(F.explode(pairs).alias("p")).groupBy(F.col("p.source").alias("source")).agg(F.count_if(F.col("p.has")).alias("covered"), F.count("*").alias("total")).withColumn("pct", F.bround(100.0 * F.col("covered") / F.greatest("total", F.lit(1)), 1))
