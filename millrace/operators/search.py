"""Searches, lookups and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import contains_any, ilike_any


def search(df: DataFrame, columns: list[str], patterns: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Rows with a column that matches a pattern, in a total order, at most limit."""
    out = df.where(ilike_any(columns, patterns)).orderBy(*order)
    return out.limit(limit) if limit else out


def bundle(parts: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Union of labelled (entity, id, label) rows, one for each entity and id."""
    frames = [df.select(F.lit(name).alias("entity"), key.cast("string").alias("id"), label.cast("string").alias("label")) for name, (df, key, label) in parts.items()]
    return reduce(DataFrame.unionByName, frames).groupBy("entity", "id").agg(F.min("label").alias("label"))


def cascade(df: DataFrame, stages: list[Column]) -> DataFrame:
    """The rows of the first stage (a predicate) that finds any, with its number, in one scan."""
    stage = F.coalesce(*(F.when(s, F.lit(i)) for i, s in enumerate(stages)))
    rows = df.withColumn("stage", stage).where(F.col("stage").isNotNull())
    first = rows.agg(F.min("stage").alias("__first"))
    return rows.join(F.broadcast(first), F.col("stage") == F.col("__first")).drop("__first")  # one row


def classify(text: Column, rules: list[tuple[str, list[str]]], default: str = "Other") -> Column:
    """The first class in order with a keyword in the upper-cased text."""
    out = None
    for name, keywords in rules:
        cond = contains_any(text, keywords)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(default) if out is None else out.otherwise(default)


def tokens(text: Column, pattern: str = r"[A-Za-z]+") -> Column:
    """Lower-case tokens of a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1), lambda t: F.lower(t))


def classify_tokens(toks: Column, rules: list[tuple[str, list[str]]], default: str = "Other") -> Column:
    """The first class in order that shares a token: boundaries count, unlike substrings."""
    out = None
    for name, keywords in rules:
        cond = F.arrays_overlap(toks, F.array(*map(F.lit, keywords)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(default) if out is None else out.otherwise(default)


def categorise(rules: list[tuple[str, Column]], default: str = "other") -> Column:
    """The name of the first predicate that holds, such as over a number and its context."""
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def weighted_vote(votes: DataFrame, key: str, candidate: str, weight: str, least: float = 0.0) -> DataFrame:
    """key, winner, weight, confidence (winner's share): the candidate with the largest summed weight; ties go to the smaller name."""
    sums = votes.groupBy(key, candidate).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(key).agg(F.min_by(F.struct(F.col(candidate).alias("winner"), F.col("w").alias("w")), F.struct(-F.col("w"), F.col(candidate))).alias("b"), F.sum("w").alias("total"))
    return best.where(F.col("b.w") >= least).select(key, "b.winner", F.col("b.w").alias("weight"), (F.col("b.w") / F.col("total")).alias("confidence"))


def priority_vote(votes: DataFrame, key: str, kind: str, priority: str) -> DataFrame:
    """key, kind: specific kinds (higher priority) beat votes, then the number of votes, then the smaller name."""
    n = votes.groupBy(key, kind).agg(F.max(priority).alias("p"), F.count("*").alias("votes"))
    return n.groupBy(key).agg(F.min_by(kind, F.struct(-F.col("p"), -F.col("votes"), F.col(kind))).alias(kind))


def multi_class(members: DataFrame, key: str, classes: dict[str, Column]) -> DataFrame:
    """Members that belong to more than one class, with the sorted classes."""
    hits = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in sorted(classes.items()))))
    return members.withColumn("classes", hits).where(F.size("classes") > 1).select(key, "classes")
