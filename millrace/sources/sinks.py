"""Sinks: named exports as JSON, CSV or Parquet, row documents, text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(frames: dict[str, DataFrame], root: str, form: str = "json") -> dict[str, str]:
    """Each frame in a folder of its own; one that fails doesn't stop the others. Returns what went wrong by name."""
    problems = {}
    for name, df in frames.items():
        try:
            if form == "csv":
                csv(df, f"{root}/{name}")
            else:
                df.write.mode("overwrite").format(form).save(f"{root}/{name}")
        except Exception as e:  # reported, not hidden
            problems[name] = f"{type(e).__name__}: {e}"
    return problems


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values with a comma, quote or line end are quoted, quotes doubled. Nested columns become JSON."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def documents(df: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def report(df: DataFrame, group: str, order: list[str], line: str, *args: str) -> DataFrame:
    """group, text: a heading and a formatted line a row, in order."""
    rows = df.select(group, F.struct(*order, F.format_string(line, *(F.col(a) for a in args)).alias("line")).alias("l"))
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col(group).cast("string")), F.array_join(F.col("ls.line"), "\n"))
    return rows.groupBy(group).agg(F.sort_array(F.collect_list("l")).alias("ls")).select(group, text.alias("text"))


def append_partition(df: DataFrame, root: str, column: str = "build") -> None:
    """Append rows to a table partitioned by a column; partitions that df has are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(root)
