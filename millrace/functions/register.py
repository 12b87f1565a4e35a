"""Functions under names for SQL: expressions as SQL functions, which the optimizer inlines, and Arrow functions where Python is needed."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession

#: name, arguments, result, expression
EXPRESSIONS = [
    ("hex_address", "x BIGINT", "STRING", "concat('0x', lower(hex(x)))"),
    ("parse_int", "x STRING", "BIGINT", "CASE WHEN lower(trim(x)) RLIKE '^0x[0-9a-f]{1,15}$' THEN try_cast(conv(substr(trim(x), 3), 16, 10) AS BIGINT) ELSE try_cast(trim(x) AS BIGINT) END"),
    ("percentage", "a DOUBLE, b DOUBLE", "DOUBLE", "bround(100.0D * a / greatest(b, 1.0D), 2)"),
    ("is_flag", "x BIGINT", "BOOLEAN", "x > 0 AND (x & (x - 1)) = 0"),
]


def register_expression(spark: SparkSession, name: str, arguments: str, result: str, expression: str) -> None:
    """A function of the session that SQL expands in place."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {expression}")


def register_arrow(spark: SparkSession, name: str, f: Callable, result: str) -> None:
    """A function of series, which come in Arrow batches, under a name."""
    from pyspark.sql.functions import pandas_udf

    spark.udf.register(name, pandas_udf(f, result))


def register_table(spark: SparkSession, name: str, handler: type, result: str) -> None:
    """A table function: a class with eval, which yields rows, under a name."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(handler, returnType=result))


def register(spark: SparkSession) -> list[str]:
    """The engine's own functions; their names."""
    def text_length(x: pd.Series) -> pd.Series:
        return x.str.len()

    for e in EXPRESSIONS:
        register_expression(spark, *e)
    register_arrow(spark, "text_length", text_length, "int")
    return [e[0] for e in EXPRESSIONS] + ["text_length"]
