"""The stateful and streaming forms of operators: file tails, event-time windows, keyed upserts and ledgers, bounded logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.merge import upsert


def tail(spark: SparkSession, path: str, schema: str, form: str = "json", files: int | None = None) -> DataFrame:
    """Files that appear below path, as a stream."""
    r = spark.readStream.schema(schema).format(form)
    return (r.option("maxFilesPerTrigger", files) if files else r).load(path)


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Captures that appear below path, split into packets as they come."""
    from millrace.sources.captures import split

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(path)
    return split(files)


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts of event-time windows by key; rows later than the watermark are dropped, state ends with it. Works on tables too."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    src = df.withWatermark(ts, late) if df.isStreaming else df
    return src.groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts of sessions that end with a gap."""
    src = df.withWatermark(ts, late) if df.isStreaming else df
    return src.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(df: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Start a stream into a function of each batch; with available_now it ends when all there is has been read."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if available_now else w).start()


class VersionedTable:
    """A table as numbered directories: a batch is folded into the last version and written as the next, so a repeated batch changes nothing.

    The version of a batch is its number plus one; a batch whose version is there already has been applied.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(root))

    def versions(self) -> list[int]:
        done = lambda s: self._fs.exists(self._path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs.listStatus(self._path(self.root)) if done(s))

    def read(self, version: int | None = None) -> DataFrame | None:
        v = self.versions()
        v = v[-1:] if version is None else [x for x in v if x == version]
        return self.spark.read.parquet(f"{self.root}/v{v[0]}") if v else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v{version}")

    def upsert_sink(self, keys: list[str], rules: dict[str, str], order: list[str]) -> Callable[[DataFrame, int], None]:
        """A sink that merges each batch by rules."""

        def sink(batch: DataFrame, number: int) -> None:
            if number + 1 in self.versions():
                return
            before = [v for v in self.versions() if v <= number]
            old = self.read(before[-1]) if before else None
            self.write(upsert(old, batch, keys, rules, order), number + 1)

        return sink


def last_n(log: DataFrame, n: int = 500, *order: str) -> DataFrame:
    """The newest n entries of a log, oldest first."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def level_counts(log: DataFrame, level: str = "level") -> DataFrame:
    return log.groupBy(level).agg(F.count("*").alias("n"))
