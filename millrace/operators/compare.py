"""Comparison of snapshots and ordered analytics over builds or periods."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_outer_compare(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, action (added, removed, changed, same) and old_/new_ columns; columns are compared null-safely."""
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("__a"))
    b = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("__b"))
    differs = reduce(or_, (~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns), F.lit(False))
    action = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(differs, "changed").otherwise("same")
    return a.join(b, keys, "full").select(*keys, action.alias("action"), *(f"{side}_{c}" for c in columns for side in ("old", "new")))


def timeline(history: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """keys, period, action: added, modified, removed events of keys over the periods that occur, and whether an addition is a return.

    Only rows of keys are read: a removal is dated to the period after the last one present, by the order of all periods (one row each).
    """
    h = history.groupBy(*keys, period).agg(F.max(value).alias("v"))
    order = h.select(period).distinct().withColumn("n", F.row_number().over(Window.orderBy(period)))  # one row a period
    following = order.select((F.col("n") - 1).alias("n"), F.col(period).alias("__next"))
    p = h.join(order, period).join(following, "n", "left")
    w = Window.partitionBy(*keys).orderBy("n")
    p = p.withColumns({"before": F.lag("n").over(w), "was": F.lag("v").over(w), "after": F.lead("n").over(w)})
    added = p.where("before IS NULL OR before < n - 1").select(*keys, period, F.lit("added").alias("action"), F.col("before").isNotNull().alias("readded"))
    modified = p.where((F.col("before") == F.col("n") - 1) & ~F.col("was").eqNullSafe(F.col("v"))).select(*keys, period, F.lit("modified").alias("action"), F.lit(False).alias("readded"))
    removed = p.where("__next IS NOT NULL AND (after IS NULL OR after > n + 1)").select(*keys, F.col("__next").alias(period), F.lit("removed").alias("action"), F.lit(False).alias("readded"))
    return added.unionByName(modified).unionByName(removed)


def volatility(events: DataFrame, keys: list[str], periods: int, digits: int = 4) -> DataFrame:
    """keys, changes, volatility (changes per gap between periods; 0 with one period), stability."""
    v = F.lit(0.0) if periods < 2 else F.bround(F.col("changes") / float(max(periods - 1, 1)), digits)
    out = events.groupBy(*keys).agg(F.count("*").alias("changes")).withColumn("volatility", v)
    return out.withColumn("stability", F.when(F.col("volatility") <= 0.15, "stable").when(F.col("volatility") <= 0.40, "moderate").when(F.col("volatility") <= 0.70, "volatile").otherwise("highly_volatile"))


def moving_average(df: DataFrame, order: str, value: str, rows: int = 3, partition: list[str] | None = None) -> DataFrame:
    """df with moving_avg over a trailing frame. Without a partition df must be one row a period."""
    w = (Window.partitionBy(*partition) if partition else Window).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("moving_avg", F.avg(value).over(w))


def trend(df: DataFrame, order: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """first, last, trend: growing above a ratio of 1.05 of last to first, shrinking below 0.95."""
    ratio = F.col("last") / F.greatest(F.col("first"), F.lit(1.0))
    out = df.groupBy(*(keys or [])).agg(F.min_by(F.col(value).cast("double"), order).alias("first"), F.max_by(F.col(value).cast("double"), order).alias("last"))
    return out.withColumn("trend", F.when(ratio > 1.05, "growing").when(ratio < 0.95, "shrinking").otherwise("stable"))


def renames(history: DataFrame, slot: list[str], ordinal: str, label: str) -> DataFrame:
    """slot, ordinal, old_label, new_label: a slot whose label differs from that of the adjacent ordinal before."""
    w = Window.partitionBy(*slot).orderBy(ordinal)
    h = history.select(*slot, ordinal, label).withColumns({"old_label": F.lag(label).over(w), "__o": F.lag(ordinal).over(w)})
    return h.where((F.col("__o") == F.col(ordinal) - 1) & (F.col("old_label") != F.col(label))).select(*slot, ordinal, "old_label", F.col(label).alias("new_label"))


def gaps(presence: DataFrame, keys: list[str], ordinal: str, last: int, total: int) -> DataFrame:
    """keys, seen, last_seen, gap, risk: high from two missed ordinals on, medium at one, or low presence (under 0.3 of at least 3)."""
    g = presence.groupBy(*keys).agg(F.countDistinct(ordinal).alias("seen"), F.max(ordinal).alias("last_seen")).withColumn("gap", F.lit(last) - F.col("last_seen"))
    rare = (F.lit(total) >= 3) & (F.col("seen") / F.lit(float(max(total, 1))) < 0.3)
    return g.withColumn("risk", F.when(F.col("gap") >= 2, "high").when(F.col("gap") >= 1, "medium").when(rare, "low_presence").otherwise("none"))


def additive_score(factors: list[Column], least: float, levels: list[tuple[float, str]], default: str) -> tuple[Column, Column, Column]:
    """Score (sum of factors, null is 0), level (first bound reached) and whether the score reaches least."""
    score = reduce(lambda a, b: a + b, (F.coalesce(f, F.lit(0.0)) for f in factors))
    level = None
    for bound, name in levels:
        level = F.when(score >= bound, name) if level is None else level.when(score >= bound, name)
    return score, level.otherwise(default), score >= least


def prior_period(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with prev (the value of the period before) and regression: soft_zero or regression where prev is at least 20 and the value 0 or under half of it."""
    out = df.withColumn("prev", F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    v, p = F.col(value), F.col("prev")
    return out.withColumn("regression", F.when((p >= 20) & (v == 0), "soft_zero").when((p >= 20) & (v < 0.5 * p), "regression").otherwise("ok"))


def stride_islands(df: DataFrame, keys: list[str], offset: str, stride: Column, least: int = 3) -> DataFrame:
    """keys, first, last, members: runs of at least `least` rows at offsets one stride apart."""
    w = Window.partitionBy(*keys).orderBy(offset)
    i = df.withColumn("__i", F.col(offset) - F.row_number().over(w) * stride)
    return i.groupBy(*keys, "__i").agg(F.min(offset).alias("first"), F.max(offset).alias("last"), F.count("*").alias("members")).where(F.col("members") >= least).drop("__i")


def field_diff(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """owner, field, change: added, removed, retyped, moved, reordered, same. Inputs: owner, fields ARRAY<STRUCT<name, type>>."""
    flat = lambda df, s: df.select(owner, F.posexplode("fields").alias(f"{s}pos", "f")).select(owner, F.col("f.name").alias("field"), F.col("f.type").alias(f"{s}type"), f"{s}pos")
    j = flat(old, "o").join(flat(new, "n"), [owner, "field"], "full")
    w = lambda p: Window.partitionBy(owner, (F.col("opos").isNotNull() & F.col("npos").isNotNull())).orderBy(p)
    j = j.withColumns({"__a": F.row_number().over(w("opos")), "__b": F.row_number().over(w("npos"))})
    change = F.when(F.col("opos").isNull(), "added").when(F.col("npos").isNull(), "removed").when(F.col("otype") != F.col("ntype"), "retyped").when(F.col("__a") != F.col("__b"), "reordered").when(F.col("opos") != F.col("npos"), "moved").otherwise("same")
    return j.select(owner, "field", change.alias("change"))


def changes(baseline: DataFrame, current: DataFrame, key: str, digest: Column, name: str | None = None) -> DataFrame:
    """key, change: new, removed, renamed, modified or unchanged, by the digest of either side's row."""
    cols = [digest.alias("h")] + ([F.col(name).alias("nm")] if name else [])
    a = baseline.select(key, F.struct(*cols).alias("a"))
    b = current.select(key, F.struct(*cols).alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed")
    if name:
        change = change.when(~F.col("a.nm").eqNullSafe(F.col("b.nm")), "renamed")
    return a.join(b, key, "full").select(key, change.when(~F.col("a.h").eqNullSafe(F.col("b.h")), "modified").otherwise("unchanged").alias("change"))


def held_pairs(steps: DataFrame, by: str, order: str, lock: str, takes: str) -> DataFrame:
    """by, order, outer, inner: what is held whenever something else is taken. takes: whether a step takes its lock or gives it back.

    A lock is held while the takes of it outnumber what gave it back, of which those without a take before don't count. So the order of
    what is held needs no fold over a group: each lock's depth lasts to its next step, and takes meet the depths that last over them.
    """
    w = Window.partitionBy(by, lock).orderBy(order)
    run = steps.select(by, order, F.col(lock).alias("outer"), F.sum(F.when(F.col(takes), 1).otherwise(-1)).over(Window.partitionBy(by, lock).orderBy(order)).alias("run"), F.lead(order).over(w).alias("__next"))
    w = Window.partitionBy(by, "outer").orderBy(order)
    held = run.withColumn("depth", F.col("run") - F.least(F.lit(0), F.min("run").over(w))).where("depth > 0").select(F.col(by).alias("__by"), F.col(order).alias("__from"), "__next", "outer")
    taken = steps.where(takes).select(by, order, F.col(lock).alias("inner"))
    lasts = (F.col(by) == F.col("__by")) & (F.col("__from") < F.col(order)) & (F.col("__next").isNull() | (F.col(order) < F.col("__next"))) & (F.col("inner") != F.col("outer"))
    return taken.join(held, lasts).select(by, order, "outer", "inner")


def transitions(df: DataFrame, keys: list[str], state: str, *order: str) -> DataFrame:
    """state, next_state, n: successive states of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("next_state", F.lead(state).over(w)).where("next_state IS NOT NULL").groupBy(F.col(state).alias("state"), "next_state").agg(F.count("*").alias("n"))
