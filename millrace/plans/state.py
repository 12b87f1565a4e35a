"""Intermediate tables of loops: written to the shared folder, so that lineage ends there and lost executors cost nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and Spark runs on one machine."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_millrace_state", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = context._millrace_state = "file://" + tempfile.mkdtemp(prefix="millrace-state-")
    here = context._jvm.org.apache.hadoop.fs.Path(path)
    whole = here.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(here).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def written(df: DataFrame, tag: str = "state") -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
