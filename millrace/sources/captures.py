"""Captures of packets as one table: direction, opcode, timestamp, data, opcode_name. Binary, text, CSV and SQL forms."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, seq bigint, direction string, opcode bigint, timestamp bigint, data binary, opcode_name string"
#: Fixed values of the binary form.
SIGNATURE, KEY_BYTES, LARGEST = b"PKT", {0x0300: 40, 0x0301: 16}, 0x1000000
DIRECTIONS = {0: "CMSG", 1: "SMSG"}
HEAD = struct.Struct("<6I")  # direction, connection, timestamp, optional length, data length, opcode
RAW_HEAD = struct.Struct("<BII")  # direction, opcode, data length


def body_start(data: bytes) -> int | None:
    """Where the records of a signed capture begin; None if it isn't one."""
    if data[:3] != SIGNATURE or len(data) < 5 or (key := KEY_BYTES.get(struct.unpack_from(">H", data, 3)[0])) is None:
        return None
    at = 5 + 1 + 4 + 4 + key + 4 + 4  # version, sniffer, build, locale, key, time, ticks
    extra = struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else 0
    return at + 4 + extra


def signed_records(data: bytes):
    """Records of a signed capture; ends at the first that is cut off or too large."""
    at = body_start(data)
    while at is not None and at + HEAD.size <= len(data):
        direction, _, ticks, extra, n, opcode = HEAD.unpack_from(data, at)
        begin = at + HEAD.size + extra
        if n > LARGEST or begin + n > len(data):
            return
        yield DIRECTIONS.get(direction, "UNKNOWN"), opcode, ticks, data[begin : begin + n]
        at = begin + n


def raw_records(data: bytes):
    """Records of an unsigned dump."""
    at = 0
    while at + RAW_HEAD.size <= len(data):
        direction, opcode, n = RAW_HEAD.unpack_from(data, at)
        begin = at + RAW_HEAD.size
        if n > LARGEST or begin + n > len(data):
            return
        yield DIRECTIONS.get(direction, "UNKNOWN"), opcode, 0, data[begin : begin + n]
        at = begin + n


def binary(spark: SparkSession, path: str, glob: str = "*.{pkt,bin}") -> DataFrame:
    """Binary captures below path, a file a task: signed ones by their header, others as raw dumps."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return split(files)


def split(files: DataFrame) -> DataFrame:
    """Records of files (path, content), in bounded batches; also for streams."""

    def of(batches):
        import pyarrow as pa

        names = ["file", "seq", "direction", "opcode", "timestamp", "data", "opcode_name"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                records = signed_records(content) if content[:3] == SIGNATURE else raw_records(content)
                some = []
                for i, r in enumerate(records):
                    some.append((path, i, *r, None))
                    if len(some) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)

    return files.select("path", "content").mapInArrow(of, SCHEMA)


#: Column names that a CSV may use.
SYNONYMS = {"direction": ("direction", "dir"), "opcode": ("opcode", "opcode_id", "opcodeid"), "opcode_name": ("opcode_name", "opcodename", "name"), "data": ("data", "payload", "hex", "hex_data")}


def below(glob: str | None) -> dict[str, str]:
    """Options of a reader that takes every file of a name below its path."""
    return {} if glob is None else {"pathGlobFilter": glob, "recursiveFileLookup": "true"}


def csv(spark: SparkSession, path: str, sep: str | None = None, glob: str | None = None) -> DataFrame:
    """CSV or TSV with a header of synonyms in any case; rows without a number for an opcode are dropped, the timestamp is kept."""
    if sep is None:
        head = spark.read.options(**below(glob)).text(path).limit(1).collect()
        sep = "\t" if head and "\t" in head[0].value else ","
    df = spark.read.options(**below(glob)).option("header", True).option("sep", sep).csv(path)
    low = {c.strip().lower(): c for c in df.columns}
    pick = {k: next((low[n] for n in names if n in low), None) for k, names in SYNONYMS.items()}
    ts = next((low[n] for n in sorted(low) if "timestamp" in n), None) or next((low[n] for n in sorted(low) if "time" in n), None)
    if pick["opcode"] is None:
        raise ValueError(f"no opcode column among {df.columns}")
    from millrace.functions.scalar import parse_int

    col = lambda c: F.lit(None).cast("string") if c is None else F.col(f"`{c}`")
    payload = F.regexp_replace(F.regexp_replace(F.coalesce(col(pick["data"]), F.lit("")), r"\s", ""), "^0[xX]", "")
    out = df.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.upper(col(pick["direction"])).alias("direction"), parse_int(col(pick["opcode"])).alias("opcode"), F.coalesce(parse_int(col(ts)), F.lit(0)).alias("timestamp"), F.when(payload.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(payload)).alias("data"), col(pick["opcode_name"]).alias("opcode_name"))
    return out.where("opcode IS NOT NULL")


#: What stands between the brackets of an INSERT: values, of which quoted ones may hold anything but a quote.
BRACKETS = r"\\(((?:[^()']|'[^']*')*)\\)"
COLUMNS = "id string, direction string, opcode string, time string, data string"


def sql_dump(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """Rows (id, direction, opcode, time, hex) of INSERT statements, a line at a time; comments are skipped. Opcodes and payloads are hexadecimal."""
    lines = spark.read.options(**below(glob)).text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v")).where(~F.col("v").rlike("^(--|#)"))
    values = lines.select("file", F.explode(F.expr(f"regexp_extract_all(v, '{BRACKETS.replace(chr(39), chr(92) + chr(39))}', 1)")).alias("row"))
    rows = values.select("file", F.monotonically_increasing_id().alias("seq"), F.from_csv("row", COLUMNS, {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(f"r.{c}"), F.lit("")), "^0[xX]", "")
    packets = rows.select("file", "seq", F.upper("r.direction").alias("direction"), F.col("r.id").alias("id"), digits("opcode").alias("op"), digits("data").alias("hex"))
    good = packets.where(F.col("direction").isin("CMSG", "SMSG", "MSG") & F.col("id").rlike("^[0-9]+$") & F.col("op").rlike("^[0-9A-Fa-f]+$") & F.col("hex").rlike("^[0-9A-Fa-f]*$"))
    return good.select("file", "seq", "direction", F.conv("op", 16, 10).try_cast("bigint").alias("opcode"), F.lit(0).cast("bigint").alias("timestamp"), F.when(F.length("hex") % 2 == 0, F.unhex("hex")).alias("data"), F.lit(None).cast("string").alias("opcode_name"))


HEX = set("0123456789abcdefABCDEF")


def header(line: str) -> tuple[str, int, str] | None:
    """direction, opcode and name of a packet's first line, 'Side: NAME (0xCODE) Length: N ..'; None if it is another."""
    side, _, rest = line.partition(":")
    name, opening, rest = rest.partition("(")
    code, closing, rest = rest.partition(")")
    who = side.split()[-1].lower() if side.split() else ""
    direction = "CMSG" if who.startswith("client") else "SMSG" if who.startswith("server") else None
    code = code.strip().lower()
    if not (direction and opening and closing and code.startswith("0x") and code[2:] and set(code[2:]) <= HEX and rest.strip().lower().startswith("length:")):
        return None
    return direction, int(code, 16), name.strip()


def dumped(line: str) -> bytes:
    """The bytes of a line of a hex dump: an offset between bars may stand before them, characters behind."""
    cells = [c.split() for c in line.strip().strip("|").split("|")]
    if len(cells) > 1 and len(cells[0]) == 1 and set(cells[0][0]) <= HEX:
        cells = cells[1:]
    out = bytearray()
    for word in cells[0]:
        if len(word) % 2 or not set(word) <= HEX or len(out) + len(word) // 2 > 16:
            break
        out += bytes.fromhex(word)
    return bytes(out)


def text(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """Text exports: a header line a packet, then hex dump lines. A file is one row of one task and must fit in its memory."""
    files = spark.read.options(**below(glob)).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def of(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = ["file", "seq", "direction", "opcode", "timestamp", "data", "opcode_name"]
        for b in batches:
            for path, value in zip(b.column("path").to_pylist(), b.column("value").to_pylist()):
                packets = []
                for line in value.splitlines():
                    if head := header(line):
                        packets.append([path, len(packets), *head[:2], 0, bytearray(), head[2]])
                    elif packets:
                        packets[-1][5] += dumped(line)
                if packets:
                    yield pa.RecordBatch.from_arrays([pa.array(map(bytes, c) if t == pa.binary() else c, t) for c, t in zip(zip(*packets), types)], names)

    return files.mapInArrow(of, SCHEMA)


FORMS = {"pkt": binary, "bin": binary, "csv": csv, "tsv": csv, "sql": sql_dump, "txt": text}


def discover(spark: SparkSession, path: str) -> DataFrame:
    """file, form, modified, length of every capture below path, by its ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")
    return files.withColumn("form", F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1))).where(F.col("form").isin(*FORMS))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """All captures below path, at any depth, whatever their form."""
    from functools import reduce

    forms = {r.form: None for r in discover(spark, path).select("form").distinct().collect()}
    parts = []
    if {"pkt", "bin"} & forms.keys():
        parts.append(binary(spark, path))
    for form in ("csv", "tsv", "sql", "txt"):
        if form in forms:
            parts.append(FORMS[form](spark, path, glob=f"*.{form}"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)
