"""Scores from columns: priority, conformance, escalation, entropy, constraints."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority(conformance: Column, unguarded: Column, high: Column, covered: Column, missing: Column) -> Column:
    """0 to 110: 30 % of the conformance deficit (10 points flat without a score), 5 a missing guard up to 40, 5 a severe finding up to 15, 15 % of the coverage deficit, 2 a missing check up to 10."""
    deficit = F.when(conformance.isNull(), F.lit(10.0)).otherwise((100 - conformance) * 0.30)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return deficit + F.least(F.lit(40.0), 5 * n(unguarded)) + F.least(F.lit(15.0), 5 * n(high)) + (100 - n(covered)) * 0.15 + F.least(F.lit(10.0), 2 * n(missing))


def conformance(calls: Column, branches: Column, validations: Column, size: Column) -> Column:
    """Weighted mean of four percentages, each within 0 to 100."""
    c = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)).cast("double")))
    return 0.30 * c(calls) + 0.20 * c(branches) + 0.30 * c(validations) + 0.20 * c(size)


def escalate(df: DataFrame, by: list[str], severity: str) -> DataFrame:
    """df with group_size and escalated: from ten in a group on MEDIUM, HIGH go one step up, from five on LOW does."""
    size = df.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.count("*").alias("group_size"))
    out = df.join(size, reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))).drop(*(f"__{c}" for c in by))
    s, n = F.col(severity), F.col("group_size")
    return out.withColumn("escalated", F.when((n >= 10) & (s == "HIGH"), "CRITICAL").when((n >= 10) & (s == "MEDIUM"), "HIGH").when((n >= 5) & (s == "LOW"), "MEDIUM").otherwise(s))


def entropy(df: DataFrame, key: str, symbols: Column, digits: int = 4) -> DataFrame:
    """key, entropy in bits of the distribution of an array's symbols; 0 for an empty one is left out."""
    n = df.select(key, F.explode(symbols).alias("x")).groupBy(key, "x").agg(F.count("*").alias("n"))
    total = F.sum("n")
    # H = log2(N) - sum(n log2 n) / N
    return n.groupBy(key).agg(F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, digits).alias("entropy"))


def violations(values: DataFrame, constraints: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """values with kind and violation: a null value or an unconstrained field never violates.

    constraints: on, kind (range, set, bitmask, unconstrained), min_val, max_val, members ARRAY<BIGINT>, mask, expected.
    """
    v = F.col(value)
    i = v.cast("bigint")
    bad = F.when(v.isNull(), False).when(F.col("kind") == "range", (v < F.col("min_val")) | (v > F.col("max_val"))).when(F.col("kind") == "set", ~F.array_contains("members", i)).when(F.col("kind") == "bitmask", i.bitwiseAND(F.col("mask")) != F.col("expected")).otherwise(False)
    return values.join(constraints, on, "left").withColumn("violation", F.coalesce(bad, F.lit(False))).drop("min_val", "max_val", "members", "mask", "expected")


def intersect(a: Column, b: Column) -> Column:
    """Constraint structs (lo, hi, members, mask, expected; null: unbounded) that hold both; contradictory masks give an empty range."""
    set_ = F.when(a["members"].isNull(), b["members"]).when(b["members"].isNull(), a["members"]).otherwise(F.array_intersect(a["members"], b["members"]))
    mask = F.when(a["mask"].isNull(), b["mask"]).when(b["mask"].isNull(), a["mask"]).otherwise(a["mask"].bitwiseOR(b["mask"]))
    expected = F.when(a["mask"].isNull(), b["expected"]).when(b["mask"].isNull(), a["expected"]).otherwise(a["expected"].bitwiseOR(b["expected"]))
    both = a["mask"].bitwiseAND(b["mask"])
    clash = F.coalesce(a["expected"].bitwiseAND(both) != b["expected"].bitwiseAND(both), F.lit(False))
    lo, hi = F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])
    return F.struct(F.when(clash, 1).otherwise(lo).cast("bigint").alias("lo"), F.when(clash, 0).otherwise(hi).cast("bigint").alias("hi"), set_.alias("members"), mask.alias("mask"), expected.alias("expected"))


def union(a: Column, b: Column) -> Column:
    """The smallest constraint struct that either satisfies: bounds are kept only where both have them."""
    either = lambda f, x, y: F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(f(x, y))
    common = a["mask"].bitwiseAND(b["mask"]).bitwiseAND(F.bitwise_not(a["expected"].bitwiseXOR(b["expected"])))
    return F.struct(either(F.least, a["lo"], b["lo"]).cast("bigint").alias("lo"), either(F.greatest, a["hi"], b["hi"]).cast("bigint").alias("hi"), either(F.array_union, a["members"], b["members"]).alias("members"), common.alias("mask"), a["expected"].bitwiseAND(common).alias("expected"))


def system_aggregate(df: DataFrame, by: str, score: str, covered: str) -> DataFrame:
    """by, members, scored, avg, min, max, coverage (share of covered rows, percent): least covered first."""
    return df.groupBy(by).agg(F.count("*").alias("members"), F.count(score).alias("scored"), F.bround(F.avg(score), 2).alias("avg"), F.min(score).alias("min"), F.max(score).alias("max"), F.bround(100 * F.avg(F.col(covered).cast("int")), 1).alias("coverage")).orderBy("coverage", by)
