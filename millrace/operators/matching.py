"""Candidates of one-to-one matches between two snapshots of a catalogue, a strategy each, for joins.priority_match.

Sides are tables of a row an id; a strategy gives lid, rid, score and closeness (which ranks equal scores). Every strategy meets on keys that
a match must share, so none compares all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import jaccard_across

#: The confidence of each strategy, and the least similarity of sets and of neighbourhoods.
NAME, OPCODE, STRINGS, SIGNATURE, CALLS, SIZE = 100.0, 95.0, 90.0, 85.0, 65.0, 50.0
SETS_LEAST, SETS_FROM, SETS_TO, CALLS_LEAST, CALLEES, CALLERS, SIZES_WITHIN, SIZE_BUCKET = 0.70, 70.0, 85.0, 0.5, 0.6, 0.4, 0.2, 64


def unique_key(old: DataFrame, new: DataFrame, lid: str, rid: str, key: str, score: float) -> DataFrame:
    """Ids that alone hold a key on their side, where the other side has it too: names, opcodes, signatures."""
    once = lambda df, i: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(i).alias(i)).where("n = 1").drop("n")
    return once(old, lid).join(once(new, rid), key).select(lid, rid, F.lit(score).alias("score"), F.lit(0.0).alias("closeness"))


def _ambiguous(cand: DataFrame, lid: str, score: Column, lowest: float) -> DataFrame:
    """Ten points less, not below lowest, where an id has several candidates."""
    n = F.count("*").over(Window.partitionBy(lid))
    return cand.withColumn("score", F.when(n > 1, F.greatest(score - 10, F.lit(lowest))).otherwise(score))


def unique_strings(old: DataFrame, new: DataFrame, lid: str, rid: str, token: str) -> DataFrame:
    """Rows (id, token) of either side: pairs by the number of tokens that one id of each side holds; five points more from three on."""
    once = lambda df, i: df.groupBy(token).agg(F.min(i).alias(i), F.max(i).alias("__most")).where(F.col(i) == F.col("__most")).drop("__most")
    pairs = once(old, lid).join(once(new, rid), token).groupBy(lid, rid).agg(F.count("*").cast("double").alias("closeness"))
    return _ambiguous(pairs, lid, F.when(F.col("closeness") >= 3, STRINGS + 5).otherwise(STRINGS), 50.0).select(lid, rid, "score", "closeness")


def _across(old: DataFrame, new: DataFrame, lid: str, rid: str, elements: str, least: float) -> DataFrame:
    """lid, rid, closeness: pairs of sets across the sides whose Jaccard similarity is least or more."""
    return jaccard_across(old, new, lid, rid, elements, least).withColumnRenamed("jaccard", "closeness")


def similar_sets(old: DataFrame, new: DataFrame, lid: str, rid: str, elements: str) -> DataFrame:
    """Sets (of n-grams) more similar than the least; the similarity in percent, within its bounds, is the score."""
    pairs = _across(old, new, lid, rid, elements, SETS_LEAST).where(F.col("closeness") > SETS_LEAST)
    score = F.greatest(F.lit(SETS_FROM), F.least(F.lit(SETS_TO), F.floor(F.round(100 * F.col("closeness"), 9)).cast("double")))
    return _ambiguous(pairs, lid, score, 50.0).select(lid, rid, "score", "closeness")


def neighbourhoods(old: DataFrame, new: DataFrame, lid: str, rid: str, callees: str, callers: str) -> DataFrame:
    """Nodes with like neighbours: .6 of the callees' similarity and .4 of the callers' pass one half. Callers alone cannot, so candidates meet on callees."""
    cand = _across(old, new, lid, rid, callees, (CALLS_LEAST - CALLERS) / CALLEES).withColumnRenamed("closeness", "__c")
    a, b = old.select(lid, F.col(callers).alias("__a")), new.select(rid, F.col(callers).alias("__b"))
    union = F.size(F.array_union("__a", "__b"))
    both = cand.join(a, lid).join(b, rid).withColumn("closeness", CALLEES * F.col("__c") + CALLERS * F.when(union > 0, F.size(F.array_intersect("__a", "__b")) / union).otherwise(0.0))
    score = F.when(F.col("closeness") > 0.8, CALLS + 10).otherwise(CALLS)
    return _ambiguous(both.where(F.col("closeness") > CALLS_LEAST), lid, score, 40.0).select(lid, rid, "score", "closeness")


def sizes(old: DataFrame, new: DataFrame, lid: str, rid: str, size: str) -> DataFrame:
    """Sizes above zero in one bucket that differ by up to a fifth of the old one; the nearer the better."""
    side = lambda df, i, s: df.where(F.col(size) > 0).select(i, F.col(size).alias(s), F.floor(F.col(size) / SIZE_BUCKET).alias("__bucket"))
    apart = F.abs(F.col("__x") - F.col("__y")) / F.col("__x")
    pairs = side(old, lid, "__x").join(side(new, rid, "__y"), "__bucket").where(apart <= SIZES_WITHIN)
    return pairs.select(lid, rid, F.lit(SIZE).alias("score"), (-apart).alias("closeness"))
