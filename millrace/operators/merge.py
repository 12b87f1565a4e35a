"""Keyed folds: upserts with a rule for each column, ledgers, first and last writer.

A batch merges in one aggregation over existing and incoming rows; existing rows have the sequence -1, so no row-at-a-time loop is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a column's rule makes of the values in sequence.
RULES = {
    "last_non_null": lambda c, seq: F.max_by(c, F.when(c.isNotNull(), seq)),  # coalesce(new, old), folded
    "last": lambda c, seq: F.max_by(c, seq),  # overwrite, nulls too
    "first": lambda c, seq: F.min_by(c, seq),
    "first_non_null": lambda c, seq: F.min_by(c, F.when(c.isNotNull(), seq)),
    "last_positive": lambda c, seq: F.coalesce(F.max_by(c, F.when(c > 0, seq)), F.min_by(c, seq)),
    "max": lambda c, seq: F.max(c),
    "min": lambda c, seq: F.min(c),
    "bit_or": lambda c, seq: F.bit_or(c),
    "count": lambda c, seq: F.count(F.lit(1)),
    "sum": lambda c, seq: F.sum(c),
}

#: The merge rules of the catalogue's tables.
TABLE_RULES = {
    "functions": (["ea"], {"rva": "last_non_null", "name": "last_non_null", "system": "last_non_null", "subsystem": "last_non_null", "size": "last_positive", "confidence": "max", "flags": "bit_or", "updated_at": "last", "created_at": "first"}),
    "vtables": (["ea"], {"rva": "last_non_null", "class_name": "last_non_null", "source": "last_non_null", "parent_class": "last_non_null", "entry_count": "max"}),
    "vtable_entries": (["vtable_ea", "slot_index"], {"func_ea": "last", "func_name": "last_non_null"}),
    "opcodes": (["direction", "internal_index"], {c: "last_non_null" for c in ("wire_opcode", "tc_name", "handler_ea", "deserializer_ea", "jam_type", "status", "notes")}),
    "jam_types": (["name"], {c: "last_non_null" for c in ("serializer_ea", "deserializer_ea", "field_count", "fields", "wire_size", "status", "notes")}),
    "db2_tables": (["name"], {c: "last_non_null" for c in ("file_data_id", "layout_hash", "meta_rva", "meta_ea", "field_count", "record_size", "index_field", "parent_index_field", "flags", "fields", "notes")}),
    "lua_api": (["namespace", "method"], {"handler_ea": "last", "arg_count": "last_non_null", "args": "last_non_null", "returns": "last_non_null", "is_protected": "last_non_null"}),
    "builds": (["build_number"], {"image_base": "last_non_null", "binary_path": "last_non_null", "notes": "last_non_null", "extraction_date": "last"}),
    "analyzer_yield": (["build", "analyzer"], {c: "last" for c in ("items", "status", "elapsed_sec", "run_id", "ts")}),
}


def upsert(existing: DataFrame | None, incoming: DataFrame, keys: list[str], rules: dict[str, str], order: list[Column | str]) -> DataFrame:
    """Existing rows with the incoming ones folded in, in the given order of the incoming."""
    seq = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    new = incoming.select(*keys, *rules, F.struct(F.lit(1).alias("new"), seq.alias("at")).alias("__seq"))
    if existing is not None:
        at = F.lit(None).cast(new.schema["__seq"].dataType["at"].dataType)
        new = existing.select(*keys, *rules, F.struct(F.lit(0).alias("new"), at.alias("at")).alias("__seq")).unionByName(new)
    return new.groupBy(*keys).agg(*(RULES[r](F.col(c), F.col("__seq")).alias(c) for c, r in rules.items()))


def last_writer(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """INSERT OR REPLACE: of each key the row that comes last."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in cols))


def first_writer(df: DataFrame, keys: list[str], *order: str, existing: DataFrame | None = None) -> DataFrame:
    """INSERT OR IGNORE: rows of keys that don't exist yet, of each key the first."""
    if existing is not None:
        df = df.join(existing.select(*keys).distinct(), keys, "left_anti")
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in cols))


def ledger(failures: DataFrame, keys: list[str], at: str, message: str, *, resolved: DataFrame | None = None, cut: int = 1000) -> DataFrame:
    """Failures counted by key: first and last time, how often, the last message (cut), open unless resolved since."""
    out = failures.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen_count"), F.max_by(F.substring(message, 1, cut), F.when(F.col(message).isNotNull(), F.struct(at, message))).alias("error_msg"))
    if resolved is None:
        return out.withColumn("resolved", F.lit(False))
    done = resolved.groupBy(*keys).agg(F.max(at).alias("__done"))
    return out.join(done, keys, "left").withColumn("resolved", F.coalesce(F.col("__done") >= F.col("last_seen"), F.lit(False))).drop("__done")
