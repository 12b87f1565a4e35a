"""JSON dumps as tables: one declarative specification a kind, with explicit schemas, alternative field names and skipped rows without an id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import parse_int


@dataclass(frozen=True)
class SourceSpec:
    """Rows of the array `path` of a document (or of the first of several that is there).

    columns: output name -> (type, accepted field names). A type of 'address' takes numbers and hexadecimal text. Rows whose required columns
    are all null are skipped. nested: output name -> DDL type of a field that is kept as it is.
    """

    kind: str
    path: tuple[str, ...]
    columns: dict[str, tuple[str, tuple[str, ...]]]
    required: tuple[str, ...]
    nested: dict[str, str] = field(default_factory=dict)

    def item(self) -> str:
        names: dict[str, str] = {}
        for kind, alts in self.columns.values():
            for a in alts:
                names[a] = {"address": "string", "int": "string"}.get(kind, kind)
        names |= self.nested
        return "struct<" + ", ".join(f"`{n}`: {t}" for n, t in names.items()) + ">"

    def schema(self) -> str:
        return ", ".join(f"`{p}` array<{self.item()}>" for p in self.path)


def value(alts: tuple[str, ...], kind: str) -> Column:
    """The first accepted field that is there and, of text, not empty."""
    parts = [F.col(f"x.`{a}`") for a in alts]
    if kind in ("address", "int"):
        return F.coalesce(*(parse_int(p) for p in parts))
    if kind == "string":
        return F.coalesce(*(F.when(p != "", p) for p in parts))
    return F.coalesce(*parts)


def load(spark: SparkSession, spec: SourceSpec, path: str, lines: bool = False) -> DataFrame:
    """Rows of the dumps at path: a document a file, or a line."""
    docs = spark.read.schema(spec.schema()).option("multiLine", not lines).json(path)
    items = F.coalesce(*(F.col(f"`{p}`") for p in spec.path), F.array().cast(f"array<{spec.item()}>"))
    rows = docs.select(F.explode(items).alias("x"))
    cols = [value(alts, kind).alias(name) for name, (kind, alts) in spec.columns.items()] + [F.col(f"x.`{n}`").alias(n) for n in spec.nested]
    out = rows.select(*cols)
    keep = None
    for r in spec.required:
        keep = F.col(r).isNotNull() if keep is None else keep | F.col(r).isNotNull()
    return out if keep is None else out.where(keep)


A = "address"
SPECS = {
    s.kind: s
    for s in [
        SourceSpec("functions", ("functions",), {"rva": (A, ("rva",)), "name": ("string", ("name",)), "source": ("string", ("source",))}, ("rva",)),
        SourceSpec("db2_metadata", ("tables",), {"name": ("string", ("name",)), "record_size": ("int", ("record_size",)), "field_count": ("int", ("field_count",)), "meta_rva": (A, ("meta_rva",)), "file_data_id": ("int", ("file_data_id",)), "layout_hash": (A, ("layout_hash",))}, ("name",)),
        SourceSpec("lua_signatures", ("functions",), {"namespace": ("string", ("namespace",)), "method": ("string", ("method", "name")), "handler_rva": (A, ("handler_rva", "address", "rva", "ea")), "arg_count": ("int", ("arg_count",))}, ("method",)),
        SourceSpec("string_xrefs", ("xrefs", "strings"), {"string_rva": (A, ("string_rva", "rva", "address")), "value": ("string", ("string", "value")), "code_rva": (A, ("code_rva",))}, ("string_rva",)),
        SourceSpec("simhash", ("functions",), {"rva": (A, ("rva",)), "size": ("int", ("size",)), "hash": ("string", ("hash",)), "blocks": ("int", ("blocks",)), "calls": ("int", ("calls",)), "strrefs": ("int", ("strrefs",))}, ("rva",)),
        SourceSpec("globals", ("globals",), {"rva": (A, ("rva", "address")), "name": ("string", ("name",)), "type": ("string", ("type",))}, ("rva",)),
        SourceSpec("offsets", ("offsets",), {"name": ("string", ("name",)), "rva": (A, ("rva", "offset"))}, ("name",)),
        SourceSpec("cvars", ("cvars",), {"name": ("string", ("name",)), "default": ("string", ("default", "default_value")), "handler_rva": (A, ("handler_rva", "rva"))}, ("name",)),
        SourceSpec("events", ("events",), {"name": ("string", ("name", "event")), "rva": (A, ("rva", "handler_rva"))}, ("name",)),
        SourceSpec("pdata", ("functions", "entries"), {"begin": (A, ("begin", "begin_rva", "rva")), "end": (A, ("end", "end_rva"))}, ("begin",)),
        SourceSpec("update_fields", ("fields",), {"object_type": ("string", ("object_type",)), "field_name": ("string", ("field_name", "name")), "field_offset": ("int", ("field_offset", "offset")), "field_size": ("int", ("field_size", "size")), "field_type": ("string", ("field_type", "type"))}, ("field_name",)),
        SourceSpec("enums", ("enums",), {"name": ("string", ("name",)), "table_rva": (A, ("table_rva",))}, ("name",), {"values": "array<struct<`index`: bigint, value: string, name: string, confidence: double>>"}),
        SourceSpec("opcode_dispatch", ("dispatch_tables",), {}, (), {"handlers": "array<struct<opcode: string, handler_rva: string, jam_name: string, direction: string>>"}),
        SourceSpec("ctor_dtor", ("entries", "constructors"), {"func_rva": (A, ("func_rva",)), "kind": ("string", ("type",)), "class_name": ("string", ("class",)), "vtable_rva": (A, ("vtable_rva",))}, ("func_rva",)),
        SourceSpec("vcall_sites", ("sites", "vcall_sites"), {"call_site_rva": (A, ("call_site_rva",)), "vtable_class": ("string", ("vtable_class",)), "slot": ("int", ("slot",)), "target_rva": (A, ("target_rva",))}, ("call_site_rva",)),
        SourceSpec("named_data", ("items", "named_data"), {"rva": (A, ("rva",)), "name": ("string", ("name",)), "section": ("string", ("section",))}, ("rva",)),
        SourceSpec("hotfix_tables", ("tables",), {"rva": (A, ("registration_rva",)), "name": ("string", ("name",)), "priority": ("int", ("priority",)), "has_string_fields": ("boolean", ("has_string_fields",))}, ("rva",)),
        SourceSpec("spell_effects", ("effects",), {"handler_rva": (A, ("handler_rva",)), "name": ("string", ("name",)), "id": ("int", ("id",)), "confidence": ("double", ("confidence",))}, ("handler_rva",)),
        SourceSpec("statemachines", ("machines",), {"func_rva": (A, ("func_rva",)), "state_count": ("int", ("state_count",))}, ("func_rva",), {"states": "array<struct<value: bigint, handler: string>>"}),
        SourceSpec("lua_metatables", ("types",), {"type_name": ("string", ("type_name",))}, ("type_name",), {"methods": "array<struct<name: string, rva: string>>"}),
        SourceSpec("vtable_methods", ("methods",), {"class_name": ("string", ("class_name", "class")), "vtable_rva": (A, ("vtable_rva",))}, ("vtable_rva",), {"methods": "array<struct<slot: bigint, `index`: bigint, rva: string, func_rva: string, method_rva: string, name: string, method_name: string>>"}),
    ]
}


def opcode_dispatch(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """direction, opcode, handler_rva, jam_name."""
    h = load(spark, SPECS["opcode_dispatch"], path, lines).select(F.explode("handlers").alias("h"))
    return h.select("h.direction", parse_int(F.col("h.opcode")).alias("opcode"), parse_int(F.col("h.handler_rva")).alias("handler_rva"), "h.jam_name").where("opcode IS NOT NULL")


def vtable_entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """vtable_rva, class_name, slot, func_rva, func_name; alternative names of the fields."""
    m = load(spark, SPECS["vtable_methods"], path, lines).select("vtable_rva", "class_name", F.explode("methods").alias("m"))
    return m.select("vtable_rva", "class_name", F.coalesce("m.slot", "m.index").alias("slot"), F.coalesce(*(parse_int(F.col(f"m.{c}")) for c in ("rva", "func_rva", "method_rva"))).alias("func_rva"), F.coalesce("m.name", "m.method_name").alias("func_name"))


def machine_states(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """func_rva, state_count, state_value, handler_rva: a row for each state of a machine."""
    m = load(spark, SPECS["statemachines"], path, lines).select("func_rva", "state_count", F.explode("states").alias("s"))
    return m.select("func_rva", "state_count", F.col("s.value").alias("state_value"), parse_int(F.col("s.handler")).alias("handler_rva"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """category, name, function_rva, handler_rva: every list of a document of categories, whatever these are called."""
    item = "array<struct<name: string, function_rva: string, code_rva: string, handler_rva: string>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {item}>").alias("m"))
    rows = text.select(F.explode("m").alias("category", "items")).select("category", F.explode("items").alias("x"))
    return rows.select("category", "x.name", F.coalesce(parse_int(F.col("x.function_rva")), parse_int(F.col("x.code_rva"))).alias("function_rva"), parse_int(F.col("x.handler_rva")).alias("handler_rva")).where("name IS NOT NULL")


def build_number(files: DataFrame, column: str = "file") -> DataFrame:
    """build: the largest number of five or six digits that a dump's name ends with."""
    return files.agg(F.max(F.regexp_extract(column, r"_(\d{5,6})\.(?:json|txt)$", 1).try_cast("bigint")).alias("build"))


def needs_import(files: DataFrame, last_build: int | None, last_import, build: int) -> bool:
    """Whether any file (modified) is newer than the last import, or the build differs."""
    if last_build != build or last_import is None:
        return True
    newest = files.agg(F.max("modified")).first()[0]
    return newest is not None and newest > last_import


def snapshot(spark: SparkSession, root: str, build: int | None = None) -> DataFrame:
    """A table partitioned by build; one build's directory alone is listed and read if it is given."""
    df = spark.read.parquet(root)
    return df if build is None else df.where(F.col("build") == build)
