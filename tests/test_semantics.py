"""Rules that differ between engines, scalar functions, merges."""

import datetime as dt

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import scalar, semantics
from millrace.operators import merge, scoring


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in KINDS.items() if k in values)) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


KINDS = {"s": "string", "n": "long", "d": "double", "t": "string"}


@pytest.mark.parametrize("text,value", [("0x1F", 31), ("31", 31), ("-0x10", -16), (" 7u ", 7), ("12ul", 12), ("junk", None), ("", None), (None, None), ("0xZZ", None)])
def test_parse_int(spark, text, value):
    assert one(spark, scalar.parse_int(F.col("s")), s=text) == value


def test_names_and_addresses(spark):
    assert one(spark, scalar.pascal_case(F.lit("CMSG_PLAYER_LOGIN"))) == "CmsgPlayerLogin"
    assert one(spark, scalar.hex_address(scalar.to_address(F.lit(255), 4096))) == "0x10ff"
    assert one(spark, scalar.to_rva(F.lit(4351), 4096)) == 255
    assert one(spark, scalar.normalise_code(F.lit('int a1 = 0x10; // x\nfoo("a\\"b", 12) /* y */'))) == "int VAR = NUM; foo(STR, NUM)"


@pytest.mark.parametrize("a,op,b,want", [("5", "<", "10", True), ("5", "=", "5.0", True), ("x", "!=", "y", True), ("x", "<", "y", False), ("5", "~", "1", True), ("a", "=", "a", True), ("3", "<>", "3", False), ("4", ">=", "4", True)])
def test_compare(spark, a, op, b, want):
    assert one(spark, scalar.compare(F.lit(a), F.lit(op), F.lit(b))) is want


def test_falsy_and_ratio(spark):
    assert one(spark, semantics.or_default(F.lit(0), 9, "number")) == 9 and one(spark, semantics.or_default(F.lit(""), "d", "string")) == "d"
    assert one(spark, semantics.or_default(F.lit(3), 9, "number")) == 3
    assert one(spark, semantics.ratio(F.lit(5), F.lit(0))) == 5.0
    assert one(spark, F.bround(F.lit(2.5), 0)) == 2.0
    with pytest.raises(ArithmeticException):
        spark.sql("SELECT 1 / 0").collect()


def test_like_ignores_case(spark):
    df = spark.createDataFrame([("Sub_1",), ("SUBX",), (None,), ("other",)], "name string")
    assert sorted(r.name for r in df.where(semantics.ilike_any(["name"], ["sub_%"])).collect()) == ["SUBX", "Sub_1"]


def test_upper_median(spark):
    for values, want in (([1, 2, 3, 4], 3), ([1, 2, 3], 2), ([7], 7), ([5, 5, 1, 1], 5)):
        assert spark.createDataFrame([(v,) for v in values], "v long").agg(semantics.upper_median("v")).first()[0] == want


def test_daily_window(spark):
    inside = lambda m, a, b: one(spark, scalar.in_daily_window(F.lit(m), a, b))
    assert inside(1400, 1320, 360) and inside(10, 1320, 360) and not inside(700, 1320, 360) and inside(700, 600, 800) and not inside(800, 600, 800)
    assert one(spark, scalar.minutes_until(F.lit(1400), 20)) == 60


def test_remap(spark):
    rows = spark.createDataFrame([("a", 5, "r1"), ("a", 15, "r2"), ("a", 25, "r3"), ("b", 1, "r4"), ("c", 1, "r5")], "family string, idx long, row string")
    families = spark.createDataFrame([("a", 100), ("b", 200)], "family string, shift long")
    offsets = spark.createDataFrame([("a", 10, 1), ("a", 20, None)], "family string, index_from long, offset long")
    got = {r.row: r.mapped for r in scalar.remap(rows, offsets, families).collect()}
    assert got == {"r1": 105, "r2": 116, "r3": None, "r4": 201, "r5": None}


def test_upsert_rules(spark):
    keys, rules = merge.TABLE_RULES["functions"]
    cols = "ea long, rva long, name string, system string, subsystem string, size long, confidence int, flags long, updated_at long, created_at long"
    old = spark.createDataFrame([(1, 10, "old", "sys", None, 5, 80, 1, 1, 1)], cols)
    new = spark.createDataFrame([(1, None, "new", None, "sub", 0, 50, 4, 2, 2), (1, 11, None, None, None, 7, 60, 0, 3, 3), (2, 9, "b", None, None, 0, 1, 2, 4, 4)], cols)
    got = {r.ea: r.asDict() for r in merge.upsert(old, new, keys, rules, ["updated_at"]).collect()}
    assert got[1] == {"ea": 1, "rva": 11, "name": "new", "system": "sys", "subsystem": "sub", "size": 7, "confidence": 80, "flags": 5, "updated_at": 3, "created_at": 1}
    assert got[2]["size"] == 0
    again = {r.ea: r.asDict() for r in merge.upsert(merge.upsert(old, new, keys, rules, ["updated_at"]), new, keys, rules, ["updated_at"]).collect()}
    assert again == got  # idempotent


def test_writers(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, seq long, v string")
    assert {r.k: r.v for r in merge.last_writer(df, ["k"], "seq").collect()} == {"a": None, "b": "y"}
    assert {r.k: r.v for r in merge.first_writer(df, ["k"], "seq").collect()} == {"a": "x", "b": "y"}
    there = spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in merge.first_writer(df, ["k"], "seq", existing=there).collect()] == ["b"]


def test_ledger(spark):
    f = spark.createDataFrame([("k", 1, "m1"), ("k", 5, "m2"), ("k", 3, None), ("j", 2, "z" * 5)], "key string, at long, msg string")
    done = spark.createDataFrame([("k", 9), ("j", 1)], "key string, at long")
    got = {r.key: (r.first_seen, r.last_seen, r.seen_count, r.error_msg, r.resolved) for r in merge.ledger(f, ["key"], "at", "msg", resolved=done, cut=3).collect()}
    assert got == {"k": (1, 5, 3, "m2", True), "j": (2, 2, 1, "zzz", False)}


def test_constraints(spark):
    kind = "struct<lo: bigint, hi: bigint, members: array<bigint>, mask: bigint, expected: bigint>"
    df = spark.createDataFrame([((1, 10, [1, 2], 3, 1), (5, None, [2, 3], 2, 2))], f"a {kind}, b {kind}")
    x = df.select(scoring.intersect(F.col("a"), F.col("b")).alias("i"), scoring.union(F.col("a"), F.col("b")).alias("u")).first()
    assert (x.i.lo, x.i.hi, x.i.members) == (1, 0, [2])  # the masks contradict each other
    assert (x.u.lo, x.u.hi, x.u.members, x.u.mask) == (1, None, [1, 2, 3], 0)


def test_conform(spark):
    df = spark.createDataFrame([("0x1", "n", "junk", 9)], "ea string, name string, size string, extra int")
    out = schemas.conform(df, "functions")
    r = out.first()
    assert out.columns[:3] == ["ea", "rva", "name"] and r.ea is None and r.name == "n" and r["size"] is None and "extra" not in out.columns


def test_escalation_and_priority(spark):
    df = spark.createDataFrame([("g", "HIGH")] * 10 + [("h", "LOW")] * 5 + [("i", "LOW")], "g string, s string")
    got = {(r.g, r.escalated) for r in scoring.escalate(df, ["g"], "s").collect()}
    assert got == {("g", "CRITICAL"), ("h", "MEDIUM"), ("i", "LOW")}
    assert one(spark, scoring.priority(F.lit(None).cast("double"), F.lit(20), F.lit(9), F.lit(50.0), F.lit(1))) == 10 + 40 + 15 + 7.5 + 2


def test_dates_stay_without_zone(spark):
    assert spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:01' AS t").first().t == dt.datetime(2024, 1, 1, 0, 0, 1)
