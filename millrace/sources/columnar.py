"""Binary fixed-header columnar files (magic WDC3 to WDC5): records of bit-packed, pallet, common and inline fields.

A file is decoded a column at a time: the records of a section are a matrix of bytes, and a field of any storage is a few shifts over it.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGICS = {b"WDC3", b"WDC4", b"WDC5"}
INLINE, PACKED, COMMON, PALLET, PALLET_ARRAY, PACKED_SIGNED = range(6)
HEADER = struct.Struct("<4s9I3H6I")
SECTION = struct.Struct("<Q7IH")
HEADER_BYTES, SECTION_BYTES, STRUCTURE_BYTES, STORAGE_BYTES = 72, 40, 4, 24
STORAGE = struct.Struct("<HH5I")
OFFSET_MAP = 1

SCHEMA = "file string, row_id bigint, field int, kind string, int_value bigint, text_value string, array_value array<bigint>"


def parse(data: bytes) -> dict | None:
    """Header, sections and the storage of the fields; None for other files."""
    if len(data) < HEADER_BYTES or data[:4] not in MAGICS:
        return None
    names = ("magic", "records", "fields", "record_size", "strings", "table_hash", "layout_hash", "min_id", "max_id", "locale", "flags", "id_index", "total_fields", "packed_offset", "lookups", "storage_size", "common_size", "pallet_size", "sections")
    h = dict(zip(names, HEADER.unpack_from(data, 0)))
    at = HEADER_BYTES
    keys = ("key", "offset", "records", "strings", "records_end", "ids", "relations", "map_ids", "copies")
    h["section"] = []
    for _ in range(h["sections"]):
        h["section"].append(dict(zip(keys, SECTION.unpack_from(data, at))))
        at += SECTION_BYTES
    h["structure"] = [struct.unpack_from("<hH", data, at + STRUCTURE_BYTES * i) for i in range(h["fields"])]
    at += STRUCTURE_BYTES * h["fields"]
    keys = ("offset", "size", "extra", "type", "a", "b", "c")
    h["storage"] = [dict(zip(keys, STORAGE.unpack_from(data, at + i))) for i in range(0, h["storage_size"], STORAGE_BYTES)]
    at += h["storage_size"]
    h["pallet"], at = data[at : at + h["pallet_size"]], at + h["pallet_size"]
    h["common"] = data[at : at + h["common_size"]]
    pallet = common = 0
    for s in h["storage"]:
        s["at"] = pallet if s["type"] in (PALLET, PALLET_ARRAY) else common
        pallet += s["extra"] * (s["type"] in (PALLET, PALLET_ARRAY))
        common += s["extra"] * (s["type"] == COMMON)
    return h


def bits(rows, offset: int, size: int):
    """A little-endian bit field of every row of a byte matrix, as uint64; 0 where the record is too short."""
    import numpy as np

    first, last = offset // 8, -(-(offset + size) // 8)
    out = np.zeros(len(rows), np.uint64)
    if size == 0 or last > rows.shape[1]:
        return out
    for i in range(first, min(last, first + 8)):
        out |= rows[:, i].astype(np.uint64) << np.uint64(8 * (i - first))
    out >>= np.uint64(offset % 8)
    if last - first > 8:  # a field of over 56 bits at an odd place
        out |= rows[:, last - 1].astype(np.uint64) << np.uint64(64 - offset % 8)
    return out & np.uint64((1 << size) - 1) if size < 64 else out


def column(h: dict, s: dict, rows, ids):
    """One field of all rows: an array of numbers, or of arrays for a pallet array."""
    import numpy as np

    kind = s["type"]
    if kind == COMMON:
        n = s["extra"] // 8
        table = np.frombuffer(h["common"], "<u4", 2 * n, s["at"]).reshape(n, 2) if n else np.zeros((0, 2), "<u4")
        order = np.argsort(table[:, 0], kind="stable")
        known, values = table[order, 0], table[order, 1].astype(np.int64)
        at = np.searchsorted(known, ids)
        hit = (at < n) & (known[np.minimum(at, max(n - 1, 0))] == ids) if n else np.zeros(len(ids), bool)
        return np.where(hit, values[np.minimum(at, max(n - 1, 0))] if n else 0, s["a"]).astype(np.int64)
    if kind in (PACKED, PACKED_SIGNED, PALLET, PALLET_ARRAY):
        v = bits(rows, s["offset"] + s["a"], s["b"]).astype(np.int64)
        if kind == PACKED_SIGNED and 0 < s["b"] < 64:
            v = np.where(v >> (s["b"] - 1) & 1 == 1, v - (1 << s["b"]), v)
        if kind in (PACKED, PACKED_SIGNED):
            return v
        pallet = np.frombuffer(h["pallet"], "<u4", len(h["pallet"]) // 4)
        width = max(s["c"], 1) if kind == PALLET_ARRAY else 1
        at = s["at"] // 4 + v[:, None] * width + np.arange(width)
        out = np.where(at < len(pallet), pallet[np.minimum(at, max(len(pallet) - 1, 0))] if len(pallet) else 0, 0).astype(np.int64)
        return out if kind == PALLET_ARRAY else out[:, 0]
    return bits(rows, 8 * (s["offset"] // 8), min(8 * (-(-(s["size"] or 32) // 8)), 64)).astype(np.int64)


def table(data: bytes):
    """ids and columns of a file's inline sections; encrypted sections are skipped, copies appended. Yields (ids, [(kind, values, texts)])."""
    import numpy as np

    h = parse(data)
    if h is None or h["flags"] & OFFSET_MAP:
        return
    for sec in h["section"]:
        n, size = sec["records"], h["record_size"]
        if sec["key"] or not n or not size or not 0 < sec["offset"] < len(data):
            continue
        n = min(n, (len(data) - sec["offset"]) // size)
        rows = np.frombuffer(data, np.uint8, n * size, sec["offset"]).reshape(n, size)
        strings = sec["offset"] + sec["records"] * size
        id_at = strings + sec["strings"]
        if sec["ids"]:
            ids = np.frombuffer(data, "<u4", min(sec["ids"] // 4, n), id_at).astype(np.int64)
            ids = np.concatenate([ids, h["min_id"] + np.arange(len(ids), n)])
        elif h["id_index"] < h["fields"]:
            width, place = h["structure"][h["id_index"]]
            ids = bits(rows, 8 * (place // 8), 32 - width if 0 < 32 - width <= 32 else 32).astype(np.int64)
        else:
            ids = h["min_id"] + np.arange(n)
        storage = h["storage"] or [{"type": INLINE, "offset": o, "size": 32 - s, "a": 0, "b": 0, "c": 0, "at": 0, "extra": 0} for s, o in h["structure"]]
        cols = []
        for s in storage:
            v = column(h, s, rows, ids)
            texts = None
            if s["type"] == INLINE and -(-(s["size"] or 32) // 8) == 4 and h["strings"]:
                texts = [cstring(data, strings + int(x)) if 0 < x < h["strings"] else None for x in v]
            cols.append((v, texts))
        copies = np.frombuffer(data, "<u4", 2 * sec["copies"], id_at + sec["ids"]).reshape(-1, 2).astype(np.int64) if sec["copies"] else np.zeros((0, 2), np.int64)
        place = {int(x): i for i, x in enumerate(ids)}
        extra = [(int(a), place[int(b)]) for a, b in copies if int(b) in place and int(a) not in place]
        pick = np.array([*range(n), *(i for _, i in extra)], np.int64)
        yield np.concatenate([ids, np.array([a for a, _ in extra], np.int64)]), [(v[pick], None if t is None else [t[i] for i in pick]) for v, t in cols]


def cstring(data: bytes, at: int) -> str | None:
    end = data.find(b"\0", at)
    return data[at : end if end >= 0 else at + 256].decode("utf-8", "replace") if at < len(data) else None


def rows(spark: SparkSession, path: str, glob: str = "*.db2") -> DataFrame:
    """file, row_id, field, kind, value columns: the cells of every file below path in long form; a file a task."""
    return cells(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content"))


def cells(files: DataFrame) -> DataFrame:
    """The cells of files (path, content)."""

    def of(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for ids, cols in table(content):
                    for i, (v, texts) in enumerate(cols):
                        n = len(ids)
                        wide = v.ndim == 2
                        kind = ["array"] * n if wide else ["string" if texts and t is not None else "int" for t in texts or [None] * n]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(ids), pa.array([i] * n, pa.int32()), pa.array(kind), pa.array([None] * n if wide else v.tolist(), pa.int64()), pa.array(texts or [None] * n, pa.string()), pa.array(v.tolist() if wide else [None] * n, pa.list_(pa.int64()))], ["file", "row_id", "field", "kind", "int_value", "text_value", "array_value"])

    return files.select("path", "content").mapInArrow(of, SCHEMA)


def search(cells: DataFrame, value: int) -> DataFrame:
    """Cells that hold a value, in whatever table and field."""
    return cells.where((F.col("int_value") == value) | F.array_contains("array_value", value)).select("file", "row_id", "field")
