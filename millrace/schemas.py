"""Schemas of the catalogue's tables and of the stream and graph tables, as DDL."""

from __future__ import annotations

FIELDS = "array<struct<name: string, type: string, bit_size: int, is_optional: boolean, condition: string, is_array: boolean, array_size_field: string>>"

TABLES = {
    "builds": "build_number bigint, image_base bigint, binary_path string, extraction_date string, notes string",
    "functions": "ea bigint, rva bigint, name string, size bigint, system string, subsystem string, confidence int, decompiled_hash string, flags bigint, created_at timestamp, updated_at timestamp",
    "opcodes": "internal_index bigint, wire_opcode bigint, direction string, tc_name string, handler_ea bigint, deserializer_ea bigint, jam_type string, status string, notes string",
    "jam_types": f"name string, serializer_ea bigint, deserializer_ea bigint, field_count int, fields {FIELDS}, wire_size int, status string, notes string",
    "db2_tables": "name string, file_data_id bigint, layout_hash bigint, meta_rva bigint, meta_ea bigint, field_count int, record_size int, index_field int, parent_index_field int, flags bigint, fields array<struct<type: string, size: int, is_signed: boolean, array_size: int>>, loadinfo_generated boolean, notes string",
    "vtables": "ea bigint, rva bigint, class_name string, entry_count int, source string, parent_class string, notes string",
    "vtable_entries": "vtable_ea bigint, slot_index int, func_ea bigint, func_name string",
    "lua_api": "namespace string, method string, handler_ea bigint, arg_count int, args array<struct<name: string, type: string>>, returns array<struct<type: string>>, is_protected boolean",
    "update_fields": "object_type string, field_name string, field_offset int, field_size int, field_type string, field_flags string, array_count int, is_dynamic boolean",
    "annotations": "ea bigint, ann_type string, value string, source string, confidence int, created_at timestamp",
    "diffing": "old_ea bigint, new_ea bigint, match_type string, confidence double, old_build bigint, new_build bigint",
    "strings": "ea bigint, value string, encoding string, system string, xref_count int",
    "failure_ledger": "build bigint, kind string, subject string, ea bigint, error_type string, error_msg string, traceback string, run_id string, first_seen timestamp, last_seen timestamp, seen_count bigint, resolved boolean",
    "analyzer_yield": "build bigint, analyzer string, items bigint, status string, elapsed_sec double, run_id string, ts timestamp",
    "catalogue_packets": "name string, opcode bigint, direction string, namespace string, file string, fields array<struct<index: int, name: string, type: string, array: boolean>>",
    "packets": "direction string, opcode bigint, ts timestamp, data binary, opcode_name string",
    "edges": "src bigint, dst bigint, weight bigint",
}

#: Columns that were added later, with their defaults: additive evolution.
ADDED: dict[str, dict[str, str]] = {"functions": {"subsystem": "CAST(NULL AS STRING)"}, "db2_tables": {"loadinfo_generated": "false"}}


def conform(df, table: str):
    """df with the columns of a table in order: missing ones get their default or null, others go; types are cast, junk becomes null."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(TABLES[table])
    have = set(df.columns)
    out = []
    for f in schema:
        kind = f.dataType.simpleString()
        if f.name in have:
            c = F.col(f.name)
            out.append((c if kind.startswith(("array", "struct")) else c.try_cast(f.dataType)).alias(f.name))
        else:
            out.append(F.expr(ADDED.get(table, {}).get(f.name, "NULL")).cast(f.dataType).alias(f.name))
    return df.select(*out)
