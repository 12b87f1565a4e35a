"""Named queries: sources and sinks in round trips through the shared folder, streams, tools and the planner."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables, query
from millrace.plans.q_relational import SQL_KEY, event_key
from millrace.plans.state import shared_folder
from millrace.sources import captures, dumps, sinks


def _folder(t: Tables, tag: str) -> str:
    return f"{shared_folder(t.spark)}/{tag}-{uuid.uuid4().hex}"


def _le32(c):
    """A number as four little-endian bytes, in hexadecimal."""
    h = F.lpad(F.hex(c), 8, "0")
    return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))


_packets = f"SELECT CASE WHEN event_id % 2 = 0 THEN 'CMSG' ELSE 'SMSG' END AS direction, {SQL_KEY} AS opcode, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM events WHERE {SQL_KEY} IS NOT NULL GROUP BY 1, 2"


def _counted(p: DataFrame) -> DataFrame:
    return p.groupBy("direction", "opcode").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("bytes"))


@query("SRC-08", sql=_packets)
def capture_scan(t: Tables) -> DataFrame:
    """Events as raw captures, one for each user and hour, split into packets again."""
    e = t.events.select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_id", "props", event_key().alias("k")).where("k IS NOT NULL")
    record = F.unhex(F.concat(F.lpad(F.hex((F.col("event_id") % 2).cast("bigint")), 2, "0"), _le32(F.col("k")), _le32(F.octet_length("props").cast("bigint")), F.hex(F.encode("props", "UTF-8"))))
    files = e.groupBy("user_id", "hour").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))), lambda x: F.hex(x.r)).alias("r"))
    return _counted(captures.split(files.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("hour").cast("string")).alias("path"), F.unhex(F.array_join("r", "")).alias("content"))))


@query("SRC-10", "SNK-02", sql=_packets)
def csv_capture_round_trip(t: Tables) -> DataFrame:
    """Packets exported as CSV under other names of the columns, and scanned."""
    folder = _folder(t, "csv")
    e = t.events.select(F.when(F.col("event_id") % 2 == 0, "cmsg").otherwise("smsg").alias("Dir"), event_key().alias("OpcodeID"), F.col("event_id").alias("Time"), F.hex(F.encode("props", "UTF-8")).alias("Payload"))
    sinks.csv(e, folder)
    return _counted(captures.csv(t.spark, folder, ","))


@query("SRC-11", sql=_packets)
def sql_dump_scan(t: Tables) -> DataFrame:
    """Packets as INSERT statements, scanned by pattern."""
    folder = _folder(t, "sql")
    line = F.format_string("INSERT INTO `packets` VALUES (%d, '%s', 0x%s, '%d', '%s');", F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "CMSG").otherwise("SMSG"), F.hex(event_key()), F.col("event_id"), F.hex(F.encode("props", "UTF-8")))
    t.events.where(event_key().isNotNull()).select(line.alias("value")).write.text(folder)
    return _counted(captures.sql_dump(t.spark, folder))


@query("SRC-02", "SRC-03", "SNK-01", sql="SELECT p_partkey AS rva, p_name AS name, p_brand AS source FROM part")
def dump_round_trip(t: Tables) -> DataFrame:
    """Tables exported as JSON documents with hexadecimal ids, and imported by specification."""
    folder = _folder(t, "json")
    items = t.part.groupBy("p_brand").agg(F.collect_list(F.struct(F.concat(F.lit("0x"), F.hex("p_partkey")).alias("rva"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"))).alias("functions"))
    problems = sinks.export({"functions": items.select("functions")}, folder)
    if problems:
        raise RuntimeError(str(problems))
    return dumps.load(t.spark, dumps.SPECS["functions"], f"{folder}/functions", lines=True)


@query("SNK-08", sql="SELECT r_name, '# ' || r_name || chr(10) || string_agg(printf('%d: %s', n_nationkey, n_name), chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def text_report(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return sinks.report(n, "r_name", ["n_nationkey"], "%d: %s", "n_nationkey", "n_name")


@query("SNK-03", sql="SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS value FROM nation")
def row_documents(t: Tables) -> DataFrame:
    return sinks.documents(t.nation)


@query("SRC-14", "SRC-01", sql="SELECT o_orderkey, year(o_orderdate)::INT AS build FROM orders WHERE year(o_orderdate) = 1997")
def snapshot_scan(t: Tables) -> DataFrame:
    """One build of a table with a partition for each, of which only the one is read."""
    folder = _folder(t, "snapshots")
    sinks.append_partition(t.orders.select("o_orderkey", F.year("o_orderdate").alias("build")), folder)
    return dumps.snapshot(t.spark, folder, 1997).select("o_orderkey", "build")


@query("STR-01", "STR-07", "SRC-16", sql="SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS seen FROM events GROUP BY 1")
def stream_upsert(t: Tables) -> DataFrame:
    """The events' files as a stream into a versioned table of users; a checkpoint makes a second run do nothing."""
    from millrace.streaming import flows

    folder = _folder(t, "stream")
    t.events.select("user_id", "event_id", "event_type", F.lit(1).cast("bigint").alias("seen")).repartition(3, "user_id").write.parquet(f"{folder}/in")
    table = flows.VersionedTable(t.spark, f"{folder}/table")
    rules = {"event_id": "max", "event_type": "last_non_null", "seen": "sum"}
    for _ in range(2):
        stream = flows.tail(t.spark, f"{folder}/in", "user_id bigint, event_id bigint, event_type string, seen bigint", "parquet", 2)
        flows.run(stream, table.upsert_sink(["user_id"], rules, ["event_id"]), f"{folder}/checkpoint").awaitTermination()
    return table.read()


@query("STR-08", sql="SELECT strftime(time_bucket(INTERVAL 1 minute, ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def minute_windows(t: Tables) -> DataFrame:
    """The windows that a stream would keep, over the whole table."""
    from millrace.streaming.flows import tumbling

    return tumbling(t.events, "ts", "1 minute", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("bucket"), "event_type", "n")


@query("STR-10", "FN-11", sql="SELECT event_type, count(*) AS n FROM events WHERE hour(ts) * 60 + minute(ts) >= 1350 OR hour(ts) * 60 + minute(ts) < 400 GROUP BY 1")
def scheduled_window(t: Tables) -> DataFrame:
    """Events inside a daily window that crosses midnight."""
    from millrace.functions.scalar import in_daily_window

    minute = F.hour("ts") * 60 + F.minute("ts")
    return t.events.where(in_daily_window(minute, 1350, 400)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("UDF-03", "ORD-02", sql="SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%bolt' AND p_size >= 25 ORDER BY p_name, p_partkey")
def tool_call(t: Tables) -> DataFrame:
    """A parameterised query called by name."""
    from millrace.plans.planner import Tools

    tools = Tools(t.spark, {"part_view": t.part})
    tools.add("find_parts", "SELECT p_partkey, p_name FROM part_view WHERE p_name ILIKE :pattern AND p_size >= :least ORDER BY p_name, p_partkey", pattern="%", least=0)
    return tools.call("find_parts", pattern="%bolt", least=25)["rows"]


@query("UDF-02", "STR-03", sql="SELECT r_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def planned_views(t: Tables) -> DataFrame:
    """Views registered with their dependencies, planned from a changed input and executed in order."""
    from millrace.functions.semantics import exact_sum
    from millrace.plans import planner

    r = planner.Registry()
    r.view("by_region", ("placed", "places"))(lambda d: d["placed"].join(d["places"], "c_nationkey").groupBy("r_name").agg(exact_sum(F.col("o_totalprice")).alias("revenue")))
    r.view("placed", ("orders", "customer"))(lambda d: d["orders"].join(d["customer"], F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_totalprice"))
    r.view("places", ("nation", "region"))(lambda d: d["nation"].join(d["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name"))
    steps = planner.plan(r, {"orders"}, set())
    inputs = {"orders": t.orders, "customer": t.customer, "nation": t.nation, "region": t.region}
    return planner.execute(r, steps, inputs)["by_region"]
