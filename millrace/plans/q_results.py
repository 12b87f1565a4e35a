"""Named queries: stored results and their getters, registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables, query
from millrace.plans.q_sources import _folder
from millrace.plans.results import Results


def _stored(t: Tables) -> Results:
    r = Results(t.spark, _folder(t, "results"))
    r.save("customers", t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"), F.min("o_orderpriority").alias("priority")))
    return r


@query("UDF-04", sql="""SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest, min(o_orderpriority) AS priority FROM orders GROUP BY 1 HAVING count(*) >= 3 AND min(o_orderpriority) = '1-URGENT' ORDER BY orders DESC, o_custkey LIMIT 20""")
def stored_top(t: Tables) -> DataFrame:
    """The first twenty of a stored result by a filter and a threshold."""
    return _stored(t).get("customers", where={"priority": "1-URGENT"}, least={"orders": 3}, top=(20, "orders"), key="o_custkey")


@query("UDF-04", sql="""WITH s AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) SELECT 'customers' AS result, o_custkey::VARCHAR AS key, 'o_custkey' AS "column" FROM s WHERE o_custkey = 12
UNION ALL SELECT 'customers', o_custkey::VARCHAR, 'orders' FROM s WHERE orders = 12""")
def stored_value_search(t: Tables) -> DataFrame:
    """Where a number stands in the stored results, in whatever column."""
    return _stored(t).search(12, {"customers": "o_custkey"})


@query("UDF-01", "FN-05", sql="""SELECT p_partkey, '0x' || lower(hex(p_partkey)) AS address, try_cast(p_partkey::VARCHAR AS BIGINT) AS parsed, round_even(100.0 * p_size / greatest(p_partkey, 1), 2)::DOUBLE AS share, (p_size > 0 AND (p_size & (p_size - 1)) = 0) AS flag,
length(p_name)::INT AS letters FROM part""")
def registered_functions(t: Tables) -> DataFrame:
    """Functions registered under names and called from SQL: expressions that the optimizer inlines, and an Arrow function."""
    from millrace.functions.register import register

    register(t.spark)
    t.part.createOrReplaceTempView("registered_part")
    return t.spark.sql("SELECT p_partkey, hex_address(p_partkey) AS address, parse_int(hex_address(p_partkey)) AS parsed, percentage(p_size, p_partkey) AS share, is_flag(p_size) AS flag, text_length(p_name) AS letters FROM registered_part")
