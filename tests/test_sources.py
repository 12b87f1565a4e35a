"""Captures, binary tables, dumps, code, sinks, decoding."""

import struct

import pytest
from pyspark.sql import functions as F

from millrace.functions import decode
from millrace.sources import captures, code, columnar, dumps, sinks


def field(type_, name, bits=0, optional=False, condition="", array=False, size=""):
    return {"type": type_, "name": name, "bit_size": bits, "is_optional": optional, "condition": condition, "is_array": array, "array_size_field": size}


def test_decode_goldens():
    d = decode.decode_record
    assert [d(b"\xa0", [field("bit", c) for c in "abc"])["decoded_values"][c] for c in "abc"] == [["1"], ["0"], ["1"]]
    r = d(b"\xa0\x34\x12", [field("bits", "a", 4), field("uint16", "b")])
    assert r["decoded_values"] == {"a": ["10"], "b": [str(0x1234)]} and r["success"]
    assert d(b"\x05\x00\xaa\xbb", [field("packed_guid", "g")])["decoded_values"]["g"] == ["0x0000000000000000" + "0000000000BB00AA"]
    assert d(b"ab\0", [field("string", "s")])["decoded_values"]["s"] == ["ab"]
    r = d(b"\x01\x02", [field("uint32", "x")])
    assert not r["success"] and r["error_field_index"] == 0
    r = d(b"\x01\x02", [field("uint8", "x")])
    assert r["success"] and "unconsumed" in r["error_message"] and r["bytes_consumed"] == 1
    assert not d(struct.pack("<H", 20_000) + b"x", [field("uint16", "n"), field("uint8", "v", array=True, size="n")])["success"]
    assert not d(b"", [field("uint8", "x")])["success"] and d(b"", [])["success"] and d(None, None)["success"]


@pytest.mark.parametrize("condition,first,there", [("f", 1, True), ("f", 0, False), ("!f", 0, True), ("f != 0", 1, True), ("f == 1", 0, False), ("unknown", 0, True), ("f_1", 0, False)])
def test_conditions(condition, first, there):
    r = decode.decode_record(bytes([first << 7, 9]), [field("bit", "f"), field("uint8", "v", optional=True, condition=condition)])
    assert ("v" in r["decoded_values"]) is there and r["success"] and r["fields_decoded"] == 2


def test_decode_frame(spark):
    kind = f"id long, data binary, fields array<{decode.FIELD}>"
    rows = [(1, bytearray(b"\x02\x07\x08"), [("uint8", "n", 0, False, "", False, ""), ("uint8", "v", 0, False, "", True, "n")]), (2, None, [])]
    got = {r.id: r for r in decode.decode(spark.createDataFrame(rows, kind), "data", "fields", ["id"]).collect()}
    assert got[1].decoded_values == {"n": ["2"], "v": ["7", "8"]} and got[2].success
    s = decode.statistics(spark.createDataFrame(rows, kind).transform(lambda d: decode.decode(d, "data", "fields", ["id"])).withColumn("g", F.lit(1)), ["g"]).first()
    assert (s.packets, s.ok, s.clean) == (2, 2, 2)


def signed(version, packets):
    head = b"PKT" + struct.pack(">H", version) + b"\1" + struct.pack("<I", 7) + b"enUS" + b"k" * captures.KEY_BYTES[version] + struct.pack("<III", 1, 2, 3) + b"opt"
    return head + b"".join(struct.pack("<6I", d, 0, t, 2, len(x), op) + b"??" + x for d, op, t, x in packets)


def test_binary_captures(spark, tmp_path):
    packets = [(0, 16, 5, b"abc"), (1, 17, 6, b"")]
    (tmp_path / "a.pkt").write_bytes(signed(0x0300, packets) + b"cut off")
    (tmp_path / "b.pkt").write_bytes(signed(0x0301, packets))
    (tmp_path / "c.bin").write_bytes(b"".join(struct.pack("<BII", d, op, len(x)) + x for d, op, _, x in packets))
    got = captures.binary(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {(r.direction, r.opcode, bytes(r.data)) for r in got} == {("CMSG", 16, b"abc"), ("SMSG", 17, b"")}
    assert {r.timestamp for r in got if r.file.endswith(".pkt")} == {5, 6}
    assert captures.body_start(b"PKT\x09\x09") is None


def test_text_captures(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dir,OpcodeID,Name,Time_ms,Hex\nsmsg,0x10,X,55,0x01 02\ncmsg,junk,Y,1,00\ncmsg,12,Z,,zz\n")
    got = {r.opcode: (r.direction, r.timestamp, bytes(r.data) if r.data is not None else None, r.opcode_name) for r in captures.csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {16: ("SMSG", 55, b"\1\2", "X"), 12: ("CMSG", 0, None, "Z")}
    (tmp_path / "b.sql").write_text("-- no\nINSERT INTO `p` VALUES (1, 'CMSG', 0x1F, '12:00', 'AABB'), (2, 'SMSG', 2a, 't', '');\n")
    got = [(r.direction, r.opcode, bytes(r.data)) for r in captures.sql_dump(spark, str(tmp_path / "b.sql")).orderBy("seq").collect()]
    assert got == [("CMSG", 0x1F, b"\xaa\xbb"), ("SMSG", 0x2A, b"")]
    (tmp_path / "c.txt").write_text("ServerToClient: SMSG_X (0x0010) Length: 3 ConnIdx: 0 Time: 01/01/2024\n01 02 03 \nClientToServer: CMSG_Y (0x0011) Length: 0\n")
    got = [(r.direction, r.opcode, bytes(r.data), r.opcode_name) for r in captures.text(spark, str(tmp_path / "c.txt")).orderBy("seq").collect()]
    assert got == [("SMSG", 16, b"\1\2\3", "SMSG_X"), ("CMSG", 17, b"", "CMSG_Y")]
    assert captures.captures(spark, str(tmp_path)).count() == 6


def table_file():
    """Two records of 8 bytes: an inline uint32 string offset, 4 + 12 packed bits (the 12 signed), a pallet index of 8 bits, and common data."""
    storage = [(0, 32, 0, 0, 0, 0, 0), (32, 4, 0, 1, 0, 4, 0), (36, 12, 0, 5, 0, 12, 0), (48, 8, 8, 3, 0, 8, 0), (0, 0, 8, 2, 77, 0, 0)]
    rec = lambda text, a, b, p: struct.pack("<I", text) + struct.pack("<H", a | (b & 0xFFF) << 4) + bytes([p, 0])
    records = rec(1, 5, -3, 1) + rec(0, 9, 100, 0)
    strings, ids, copies = b"\0hello\0", struct.pack("<II", 100, 200), struct.pack("<II", 300, 100)
    pallet, common = struct.pack("<II", 11, 22), struct.pack("<II", 200, 5)
    storage_bytes = b"".join(struct.pack("<HH5I", *s) for s in storage)
    structure = b"".join(struct.pack("<hH", 0, 0) for _ in storage)
    at = 72 + 40 + len(structure) + len(storage_bytes) + len(pallet) + len(common)
    head = struct.pack("<4s9I3H6I", b"WDC5", 2, 5, 8, len(strings), 1, 2, 100, 200, 0, 0, 0, 5, 0, 0, len(storage_bytes), len(common), len(pallet), 1).ljust(72, b"\0")
    section = struct.pack("<Q7IH", 0, at, 2, len(strings), 0, len(ids), 0, 0, 1).ljust(40, b"\0")
    return head + section + structure + storage_bytes + pallet + common + records + strings + ids + copies


def test_columnar(spark, tmp_path):
    (tmp_path / "t.db2").write_bytes(table_file())
    (tmp_path / "junk.db2").write_bytes(b"nothing")
    cells = columnar.rows(spark, str(tmp_path))
    got = {(r.row_id, r.field): r.text_value if r.kind == "string" else r.int_value for r in cells.collect()}
    assert got == {(100, 0): "hello", (100, 1): 5, (100, 2): -3, (100, 3): 22, (100, 4): 77, (200, 0): 0, (200, 1): 9, (200, 2): 100, (200, 3): 11, (200, 4): 5, (300, 0): "hello", (300, 1): 5, (300, 2): -3, (300, 3): 22, (300, 4): 77}
    assert {(r.row_id, r.field) for r in columnar.search(cells, 22).collect()} == {(100, 3), (300, 3)}


def test_dumps(spark, tmp_path):
    p = lambda n, text: (tmp_path / n).write_text(text) and str(tmp_path / n)
    f = dumps.load(spark, dumps.SPECS["functions"], p("f_12345.json", '{"functions": [{"rva": "0x10", "name": "a"}, {"rva": 32, "name": ""}, {"name": "no id"}]}'))
    assert {(r.rva, r.name) for r in f.collect()} == {(16, "a"), (32, None)}
    x = dumps.load(spark, dumps.SPECS["string_xrefs"], p("x.json", '{"strings": [{"address": "0x5", "value": "v"}]}'))
    assert [(r.string_rva, r.value) for r in x.collect()] == [(5, "v")]
    assert dumps.load(spark, dumps.SPECS["functions"], p("e.json", '{"functions": []}')).count() == 0
    v = dumps.vtable_entries(spark, p("v.json", '{"methods": [{"class": "C", "vtable_rva": "0x1", "methods": [{"index": 0, "func_rva": "0x2", "method_name": "m"}]}]}'))
    assert [tuple(r) for r in v.collect()] == [(1, "C", 0, 2, "m")]
    m = dumps.messages(spark, p("m.json", '{"client": [{"name": "A", "code_rva": "0x3"}], "server": [{"name": "B"}]}'))
    assert {(r.category, r.name, r.function_rva) for r in m.collect()} == {("client", "A", 3), ("server", "B", None)}
    o = dumps.opcode_dispatch(spark, p("o.json", '{"dispatch_tables": [{"handlers": [{"opcode": "0x7", "handler_rva": 9, "direction": "c"}, {"opcode": "?"}]}]}'))
    assert [(r.opcode, r.handler_rva) for r in o.collect()] == [(7, 9)]
    files = spark.createDataFrame([("a_12345.json",), ("b_67890.txt",), ("c.json",)], "file string")
    assert dumps.build_number(files).first().build == 67890


def test_code(spark, tmp_path):
    (tmp_path / "p.h").write_text("class Login final : public Packet\n{\n    uint32 Id = 0;\n    std::vector<uint8> Data;\n};\nenum Op : uint32\n{\n    OP_A = 0x10,\n    OP_B = 17\n};\n")
    s = code.structs(spark, str(tmp_path / "p.h")).first()
    assert s.name == "Login" and [(f.name, f.type, f.array) for f in s.fields] == [("Id", "uint32", False), ("Data", "std::vector<uint8>", True)]
    assert {(r.name, r.value) for r in code.enums(spark, str(tmp_path / "p.h")).collect()} == {("OP_A", 16), ("OP_B", 17)}
    (tmp_path / "t.dbd").write_text("COLUMNS\nint ID\nint<Map::ID> MapID\nlocstring Name_lang?\n\nLAYOUT 1\n")
    assert {(r.type, r.name, r.refers_to) for r in code.definitions(spark, str(tmp_path / "t.dbd")).collect()} == {("int", "ID", None), ("int", "MapID", "Map::ID"), ("locstring", "Name_lang", None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', [1, 2])], "id long, s string, l array<long>")
    sinks.csv(df, f"{tmp_path}/c")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/c").first()
    assert back.s == 'a "q", b\nc' and back.l == "[1,2]"
    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    problems = sinks.export({"good": df, "bad": bad}, f"{tmp_path}/e")
    assert set(problems) == {"bad"} and spark.read.json(f"{tmp_path}/e/good").count() == 1
    r = sinks.report(spark.createDataFrame([("g", 2, "y"), ("g", 1, "x")], "g string, n long, s string"), "g", ["n"], "%d: %s", "n", "s").first()
    assert r.text == "# g\n1: x\n2: y"
    for b in (1, 2, 1):
        sinks.append_partition(spark.createDataFrame([(b * 10, b)], "v long, build long"), f"{tmp_path}/t")
    assert dumps.snapshot(spark, f"{tmp_path}/t").count() == 2 and dumps.snapshot(spark, f"{tmp_path}/t", 2).first().v == 20
