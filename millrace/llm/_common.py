"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What separates words once A-Z is lower-cased; words keep 0-9, a-z and everything beyond ASCII.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as a URI: spark.checkpoint.dir. Only where the session names none (tests, one machine) a temporary folder is made."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_millrace_shared", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = context._millrace_shared = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
    here = context._jvm.org.apache.hadoop.fs.Path(path)
    whole = here.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(here).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster built-in, which does the same to them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK, -1), "")


def fresh(name: str, columns: list[str]) -> str:
    """name, lengthened until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a new column that names each row by file and place, the same however the files are split or how often they are read, and its name.

    A DataFrame that isn't read from files is written to the shared folder first.
    """
    name = fresh("__row", docs.columns)
    key = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias(name)
    try:
        return docs.select("*", key), name
    except AnalysisException:
        return materialize(docs, "rows").select("*", key), name


def drop_rows(keyed: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """keyed (of with_row_key) without the rows whose key is the one column of rows."""
    return keyed.join(materialize(rows.toDF(name), "dropped"), name, "left_anti").drop(name)


#: What one task would read, in bytes.
SMALL = 20 << 20


def cores_for(df: DataFrame) -> int | None:
    """The number of cores if df is so small that one task would read it all, else None: larger tables have tasks enough."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.sparkSession.sparkContext.defaultParallelism if size <= SMALL else None


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is small, so that workers in Python share it."""
    n = cores_for(df)
    return df.repartition(n) if n else df


_kept: dict[str, object] = {}


def kept(key: str, make):
    """One object in each worker process, that of the last key: what a model has learned of its texts stays from task to task, and goes when another comes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def ship(spark: SparkSession) -> None:
    """Send this subpackage to the Python workers, once for each context: they need not have it installed.

    Batches sent to them are made small where the session has Spark's defaults, since a row may hold a whole book.
    """
    context = spark.sparkContext
    for name, default, small in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", small)
    if getattr(context, "_millrace_shipped", False):
        return
    import os
    import zipfile

    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace-llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        z.writestr("millrace/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"millrace/llm/{name}")
    context.addPyFile(target)
    context._millrace_shipped = True
