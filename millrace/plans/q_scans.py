"""Named queries: scans of the forms of files that the tables are first written in, and what decides whether to read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables, query
from millrace.plans.q_relational import event_key
from millrace.plans.q_sources import _counted, _folder, _packets
from millrace.sources import captures, code, columnar, dumps, sinks


def _hexed(c: str | Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(c))


def _texts(events: DataFrame) -> DataFrame:
    """A header line and lines of up to 16 bytes for each event."""
    cells = F.regexp_replace(F.hex(F.encode("props", "UTF-8")), "(..)", "$1 ")
    head = F.format_string("%s: NAME_%d (0x%s) Length: %d", F.when(F.col("event_id") % 2 == 0, "ClientToServer").otherwise("ServerToClient"), event_key(), F.hex(event_key()), F.octet_length("props"))
    return events.where(event_key().isNotNull()).select(F.concat_ws("\n", head, F.regexp_replace(cells, "((?:.. ){1,16})", "$1\n")).alias("value"))


@query("SRC-09", sql=_packets)
def text_capture_scan(t: Tables) -> DataFrame:
    """Events as text exports with hex dumps, scanned."""
    folder = _folder(t, "text")
    _texts(t.events).write.text(folder)
    return _counted(captures.text(t.spark, folder))


@query("SRC-12", sql=_packets)
def discovered_captures(t: Tables) -> DataFrame:
    """Captures of two forms in folders below one, found by their endings and read as one table."""
    folder = _folder(t, "mixed")
    even = F.coalesce(F.col("user_id") % 2 == 0, F.lit(False))
    e = t.events.select("user_id", "event_id", "props")
    rows = e.where(even).select(F.when(F.col("event_id") % 2 == 0, "cmsg").otherwise("smsg").alias("Dir"), event_key().alias("OpcodeID"), F.col("event_id").alias("Time"), F.hex(F.encode("props", "UTF-8")).alias("Payload"))
    sinks.csv(rows, f"{folder}/rows")
    _texts(e.where(~even)).write.text(f"{folder}/texts")
    return _counted(captures.captures(t.spark, folder))


@query("SRC-05", sql="SELECT n_name AS category, s_name AS name, s_suppkey::BIGINT AS function_rva, s_nationkey::BIGINT AS handler_rva FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def message_scan(t: Tables) -> DataFrame:
    """Suppliers as documents whose categories are the nations, whatever these are called."""
    folder = _folder(t, "messages")
    item = F.struct(F.col("s_name").alias("name"), _hexed("s_suppkey").alias("code_rva"), _hexed(F.col("s_nationkey").cast("bigint")).alias("handler_rva"))
    docs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.collect_list(item).alias("items"))
    docs.select(F.to_json(F.create_map("n_name", "items")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return dumps.messages(t.spark, folder)


@query("SRC-04", sql="SELECT l_orderkey AS vtable_rva, 'order ' || l_orderkey AS class_name, l_linenumber::BIGINT AS slot, l_partkey AS func_rva, 'm' || l_suppkey AS func_name FROM lineitem")
def method_table_scan(t: Tables) -> DataFrame:
    """Orders as tables of methods, a document each, under the second names of the fields."""
    folder = _folder(t, "methods")
    item = F.struct(F.col("l_linenumber").cast("bigint").alias("index"), _hexed("l_partkey").alias("func_rva"), F.concat(F.lit("m"), F.col("l_suppkey")).alias("method_name"))
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(item).alias("methods"))
    orders.select(F.array(F.struct(F.concat(F.lit("order "), F.col("l_orderkey")).alias("class"), _hexed("l_orderkey").alias("vtable_rva"), "methods")).alias("methods")).write.json(folder)
    return dumps.vtable_entries(t.spark, folder, lines=True)


@query("SRC-04", sql="SELECT o_orderstatus AS direction, o_orderkey AS opcode, o_custkey AS handler_rva, o_orderpriority AS jam_name FROM orders")
def dispatch_scan(t: Tables) -> DataFrame:
    """Orders as handlers, a dispatch table for each customer."""
    folder = _folder(t, "dispatch")
    item = F.struct(_hexed("o_orderkey").alias("opcode"), _hexed("o_custkey").alias("handler_rva"), F.col("o_orderpriority").alias("jam_name"), F.col("o_orderstatus").alias("direction"))
    t.orders.groupBy("o_custkey").agg(F.collect_list(item).alias("handlers")).select(F.array(F.struct("handlers")).alias("dispatch_tables")).write.json(folder)
    return dumps.opcode_dispatch(t.spark, folder, lines=True)


@query("SRC-04", sql="""SELECT o_orderkey AS func_rva, o_custkey::BIGINT AS state_count, l_linenumber::BIGINT AS state_value, l_partkey AS handler_rva FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def state_machine_scan(t: Tables) -> DataFrame:
    """Orders as machines whose states are their lines."""
    folder = _folder(t, "machines")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("value"), _hexed("l_partkey").alias("handler"))).alias("states"))
    machine = F.struct(_hexed("o_orderkey").alias("func_rva"), F.col("o_custkey").alias("state_count"), "states")
    t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.array(machine).alias("machines")).write.json(folder)
    return dumps.machine_states(t.spark, folder, lines=True)


def _le(c: Column | int, size: int) -> Column:
    """A number as little-endian bytes, in hexadecimal."""
    h = F.lpad(F.hex(F.lit(c).cast("bigint") if isinstance(c, int) else c.cast("bigint")), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * (size - i) - 1, 2) for i in range(size)))


@query("SRC-06", "SRC-07", sql="""SELECT p_brand AS file, p_partkey AS row_id, 0 AS field, p_size::BIGINT AS int_value FROM part UNION ALL SELECT p_brand, p_partkey, 1, p_partkey & 1048575 FROM part
UNION ALL SELECT p_brand, p_partkey, 2, p_partkey % 4096 - 2048 FROM part""")
def columnar_scan(t: Tables) -> DataFrame:
    """Brands as columnar files of an inline field, 20 packed bits and 12 signed ones, decoded to cells."""
    packed = F.col("p_partkey").bitwiseAND(0xFFFFF) + F.shiftleft((F.col("p_partkey") % 4096 - 2048).bitwiseAND(0xFFF), 20)
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", F.concat(_le(F.col("p_size"), 4), _le(packed, 4)).alias("r"))))
    files = t.part.groupBy("p_brand").agg(rows.alias("rows"), F.count("*").alias("n"), F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    storage = [(0, 32, 0, 0, 0, 0, 0), (32, 20, 0, 1, 0, 20, 0), (52, 12, 0, 5, 0, 12, 0)]
    at = 72 + 40 + 4 * len(storage) + 24 * len(storage)
    head = [F.lit("57444335"), *(_le(x, 4) for x in (F.col("n"), len(storage), 8, 0, 1, 2, F.col("low"), F.col("high"), 0)), *(_le(x, 2) for x in (0, 0, len(storage))), *(_le(x, 4) for x in (0, 0, 24 * len(storage), 0, 0, 1)), _le(0, 2)]
    section = [_le(0, 8), *(_le(x, 4) for x in (at, F.col("n"), 0, 0, 4 * F.col("n"), 0, 0)), _le(0, 2), _le(0, 2)]
    fields = [F.lit("00000000" * len(storage)), *(_le(x, 2 if i < 2 else 4) for s in storage for i, x in enumerate(s))]
    body = [F.array_join(F.transform("rows", lambda r: r.r), ""), F.array_join(F.transform("rows", lambda r: _le(r.p_partkey, 4)), "")]
    cells = columnar.cells(files.select(F.col("p_brand").alias("path"), F.unhex(F.concat(*head, *section, *fields, *body)).alias("content")))
    return cells.select("file", "row_id", "field", "int_value")


@query("SRC-13", sql="""WITH p AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS owner, p_partkey, p_size FROM part)
SELECT 'entry' AS kind, owner, 'P_' || p_partkey AS name, p_partkey AS value, 'enum' AS type FROM p UNION ALL
SELECT 'member', owner, 'P_' || p_partkey, row_number() OVER (PARTITION BY owner ORDER BY p_partkey) - 1, CASE WHEN p_size >= 25 THEN 'std::vector<uint8>' ELSE 'uint32' END FROM p UNION ALL
SELECT 'column', owner, 'P_' || p_partkey, NULL, CASE WHEN p_size >= 25 THEN 'Map::ID' END FROM p""")
def code_scan(t: Tables) -> DataFrame:
    """Brands as source files with an enumeration, a class and a table definition, scanned."""
    folder = _folder(t, "code")
    by = t.part.groupBy(F.regexp_replace("p_brand", "[^A-Za-z0-9_]", "_").alias("owner")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("p"))
    line = lambda sep, f: F.array_join(F.transform("p", f), sep)
    entry = lambda x: F.concat(F.lit("    P_"), x.p_partkey, F.lit(" = 0x"), F.hex(x.p_partkey))
    member = lambda x: F.concat(F.lit("    "), F.when(x.p_size >= 25, "std::vector<uint8>").otherwise("uint32"), F.lit(" P_"), x.p_partkey, F.lit(";"))
    column = lambda x: F.concat(F.when(x.p_size >= 25, "int<Map::ID>").otherwise("int"), F.lit(" P_"), x.p_partkey, F.lit("?"))
    text = F.concat(F.lit("enum "), "owner", F.lit(" : uint32\n{\n"), line(",\n", entry), F.lit("\n};\nclass "), "owner", F.lit(" final : public Packet\n{\n"), line("\n", member), F.lit("\n};\n"))
    by.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/headers")
    by.select(F.concat(F.lit("COLUMNS\n"), line("\n", column), F.lit("\n\nLAYOUT 1")).alias("value"), "owner").write.partitionBy("owner").text(f"{folder}/definitions")
    enums = code.enums(t.spark, f"{folder}/headers").select(F.lit("entry").alias("kind"), F.col("enum").alias("owner"), "name", "value", F.lit("enum").alias("type"))
    members = code.structs(t.spark, f"{folder}/headers").select(F.col("name").alias("owner"), F.explode("fields").alias("f")).select(F.lit("member").alias("kind"), "owner", "f.name", F.col("f.index").cast("bigint").alias("value"), "f.type")
    columns = code.definitions(t.spark, f"{folder}/definitions").select(F.lit("column").alias("kind"), F.regexp_extract("path", "owner=([^/]+)/", 1).alias("owner"), "name", F.lit(None).cast("bigint").alias("value"), F.col("refers_to").alias("type"))
    return enums.unionByName(members).unionByName(columns)


@query("SRC-15", "SRC-17", sql=r"""
WITH f AS (SELECT 'functions_' || (10000 + o_orderkey) || '.json' AS file, o_orderdate AS modified FROM orders), b AS (SELECT max(try_cast(nullif(regexp_extract(file, '_(\d{5,6})\.(?:json|txt)$', 1), '') AS BIGINT)) AS build, max(modified) AS newest FROM f)
SELECT build, situation, needed FROM b, (SELECT 'never read' AS situation, true AS needed UNION ALL SELECT 'another build', true UNION ALL SELECT 'a newer file', (SELECT newest > TIMESTAMP '1994-06-01' FROM b) UNION ALL SELECT 'up to date', false)""")
def import_needed(t: Tables) -> DataFrame:
    """The build that names of files tell, and whether they are to be read again."""
    from datetime import datetime

    files = t.orders.select(F.format_string("functions_%d.json", F.col("o_orderkey") + 10_000).alias("file"), F.col("o_orderdate").alias("modified"))
    build = dumps.build_number(files).first().build
    newest = files.agg(F.max("modified")).first()[0]
    cases = {"never read": (None, None), "another build": (-1, newest), "a newer file": (build, datetime(1994, 6, 1)), "up to date": (build, newest)}
    rows = [(build, name, dumps.needs_import(files, last, at, build)) for name, (last, at) in cases.items()]
    return t.spark.createDataFrame(rows, "build bigint, situation string, needed boolean")
