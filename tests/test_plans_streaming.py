"""The planner, the tools, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.merge import RULES
from millrace.plans import planner
from millrace.streaming import flows


@pytest.fixture
def registry():
    r = planner.Registry()
    r.view("a", ("raw",), ("k",))(lambda d: d["raw"].select("k", (F.col("v") + 1).alias("v")))
    r.view("b", ("a",))(lambda d: d["a"].groupBy().agg(F.sum("v").alias("s")))
    r.view("c", ("other",))(lambda d: d["other"])
    r.view("d", ("b", "c"))(lambda d: d["b"].crossJoin(d["c"]))
    return r


def test_order_and_plan(registry):
    assert registry.order() == ["a", "c", "b", "d"]
    steps = planner.plan(registry, {"raw"}, set(), {"a": 2.0})
    assert [(s.view, s.reason) for s in steps] == [("a", "changed"), ("c", "prerequisite"), ("b", "dependent"), ("d", "dependent")] and steps[0].seconds == 2.0
    assert [s.view for s in planner.plan(registry, {"raw"}, {"c"})] == ["a", "b", "d"]
    assert planner.plan(registry, {"nothing"}, set()) == []
    registry.views["a"] = planner.View("a", lambda d: d, ("d",))
    with pytest.raises(ValueError):
        registry.order()
    assert registry.missing({"a", "x"}) == {"unregistered": {"x"}, "not_run": {"b", "c", "d"}}


def test_execute_on_changed_keys(spark, registry):
    raw = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    other = spark.createDataFrame([(5,)], "o long")
    steps = planner.plan(registry, {"raw"}, set())
    assert planner.execute(registry, steps, {"raw": raw, "other": other})["d"].first().s == 32
    some = planner.execute(registry, steps, {"raw": raw, "other": other}, changed={"raw": spark.createDataFrame([(2,)], "k long")}, only={"a"})
    assert [(r.k, r.v) for r in some["a"].collect()] == [(2, 21)] and set(some) == {"a"}


def test_detect_and_cache(spark):
    base = spark.createDataFrame([(1, "n", 1), (2, "n", 2), (3, "n", 3)], "id long, name string, v long")
    now = spark.createDataFrame([(1, "n", 1), (2, "m", 2), (3, "n", 9), (4, "n", 4)], "id long, name string, v long")
    got = {r.id: r.change for r in planner.detect(base, now, "id", ["v"], "name").collect()}
    assert got == {1: "unchanged", 2: "renamed", 3: "modified", 4: "new"}
    assert {r.change for r in planner.detect(None, now, "id", ["v"]).collect()} == {"new"}
    keys, cache = spark.createDataFrame([(1, "h1"), (2, "x")], "id long, h string"), spark.createDataFrame([(1, "h1", "r"), (2, "h2", "r")], "id long, h string, r string")
    hit, miss = planner.cached(keys, cache, "id", "h")
    assert [r.id for r in hit.collect()] == [1] and [r.id for r in miss.collect()] == [2]


def test_tools(spark):
    t = planner.Tools(spark, {"names": spark.createDataFrame([("Sub_1",), ("other",)], "name string")})
    t.add("search", "SELECT name FROM names WHERE name ILIKE :pattern ORDER BY name LIMIT 50", pattern="%")
    assert [r.name for r in t.call("search", pattern="sub%")["rows"].collect()] == ["Sub_1"]
    assert t.call("search")["rows"].count() == 2 and "error" in t.call("none") and "error" in t.call("search", x=1)


def test_stream_upsert_and_replay(spark, tmp_path):
    src, table = tmp_path / "in", flows.VersionedTable(spark, f"file://{tmp_path}/table")
    src.mkdir()
    write = lambda n, rows: (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("k", "seq", "v"), r))) for r in rows))
    write(1, [("a", 1, "x"), ("b", 1, "y")])
    rules = {"seq": "max", "v": "last_non_null"}
    assert set(rules.values()) <= set(RULES)

    def go():
        q = flows.run(flows.tail(spark, str(src), "k string, seq long, v string"), table.upsert_sink(["k"], rules, ["seq"]), f"{tmp_path}/cp")
        q.awaitTermination(120)

    go()
    write(2, [("a", 2, None), ("c", 1, "z")])
    go()
    assert {r.k: (r.seq, r.v) for r in table.read().collect()} == {"a": (2, "x"), "b": (1, "y"), "c": (1, "z")}
    assert table.versions() == [1, 2]
    table.upsert_sink(["k"], rules, ["seq"])(spark.createDataFrame([("q", 1, "q")], "k string, seq long, v string"), 1)  # the batch is there already
    assert table.read().count() == 3


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:02:00", "a")], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
    assert sorted(r.n for r in flows.tumbling(df, "ts", "1 minute", ["k"]).collect()) == [1, 2]
    assert sorted(r.n for r in flows.sessions(df, "ts", "45 seconds", ["k"]).collect()) == [1, 2]
    df.write.json(f"{tmp_path}/in")
    out = flows.tumbling(flows.tail(spark, f"{tmp_path}/in", "ts timestamp, k string"), "ts", "1 minute", ["k"])
    q = out.writeStream.format("memory").queryName("w1").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("w1").collect()) == [1, 2]
    assert [r.n for r in flows.last_n(spark.createDataFrame([(i,) for i in range(9)], "n long"), 3, "n").collect()] == [6, 7, 8]
    assert flows.first_seen(df, ["k"], "ts").count() == 1
