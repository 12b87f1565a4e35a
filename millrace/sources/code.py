"""Source text as rows: classes of packets and their fields, enumerations, and column definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASS = r"(?s)(?:class|struct)\s+(\w+)[^;{]*\{(.*?)\n\s*\};"
MEMBER = r"(?m)^\s*([\w:<>, ]+?)\s+(\w+)(?:\s*=\s*[^;]+)?;"
ENUM = r"(?s)enum\s+(?:class\s+)?(\w+)[^{]*\{(.*?)\}"
ENTRY = r"(\w+)\s*=\s*(0x[0-9A-Fa-f]+|\d+)"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value")


def structs(spark: SparkSession, path: str) -> DataFrame:
    """file, name, fields ARRAY<STRUCT<index, name, type, array>>: the classes of source files."""
    blocks = files(spark, path).select("file", F.explode(F.regexp_extract_all("value", F.lit(f"({CLASS})"), 1)).alias("b"))
    body = F.regexp_extract("b", CLASS, 2)
    members = F.regexp_extract_all(body, F.lit(f"({MEMBER})"), 1)
    fields = F.transform(members, lambda m, i: F.struct(i.alias("index"), F.regexp_extract(m, MEMBER, 2).alias("name"), F.trim(F.regexp_extract(m, MEMBER, 1)).alias("type"), F.regexp_extract(m, MEMBER, 1).rlike("vector|Array").alias("array")))
    return blocks.select("file", F.regexp_extract("b", CLASS, 1).alias("name"), fields.alias("fields"))


def enums(spark: SparkSession, path: str) -> DataFrame:
    """file, enum, name, value. What a block says once is taken from it before its entries become rows."""
    from millrace.functions.scalar import parse_int

    blocks = files(spark, path).select("file", F.explode(F.regexp_extract_all("value", F.lit(f"({ENUM})"), 1)).alias("b"))
    lists = blocks.select("file", F.regexp_extract("b", ENUM, 1).alias("enum"), F.regexp_extract_all(F.regexp_extract("b", ENUM, 2), F.lit(f"({ENTRY})"), 1).alias("es"))
    entries = lists.select("file", "enum", F.explode("es").alias("e"))
    return entries.select("file", "enum", F.regexp_extract("e", ENTRY, 1).alias("name"), parse_int(F.regexp_extract("e", ENTRY, 2)).alias("value"))


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """file, path, type, name, refers_to: the COLUMNS of table definition files."""
    line = r"^(\w+)(?:<(\w+::\w+)>)?\s+(\w+)\??"
    rows = files(spark, path).select("file", "path", F.explode(F.split(F.regexp_extract("value", r"(?s)COLUMNS\s*\n(.*?)(?:\n\s*\n|\z)", 1), "\n")).alias("l"))
    return rows.where(F.col("l").rlike(line)).select("file", "path", F.regexp_extract("l", line, 1).alias("type"), F.regexp_extract("l", line, 3).alias("name"), F.nullif(F.regexp_extract("l", line, 2), F.lit("")).alias("refers_to"))
