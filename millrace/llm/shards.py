"""A store of shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable shards. Compaction looks at runs of similar size: shards below the target are divided into tiers
by size, and within a tier neighbours are merged into files of about the target size, each by a task that reads only its own runs. Neither
step changes a shard that is there. A new manifest, the list of the live shards, is written aside and put in place under the next version
by a rename that fails if that version exists, so that readers see all of a step or nothing, and of two writers one; what the other wrote
has names of its own and is never read. A job merges up to BATCH files, one a task; the driver holds the names of one such batch. Reading a
version takes the paths of its shards to the driver, as any read of files does.

Sizes are counted in bytes of text. Defined results: null texts count 0 bytes; a null id goes to the arrival of the id 'null'. Repeated
rows stay. All columns are stored, whatever their names; rows of other columns than the store's are refused. An empty table makes a version
without shards.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import fresh, new_path, read

ARRIVAL = 8 << 20
TARGET = 64 << 20
#: Sizes within a factor of 4 of each other are similar.
FACTOR = 4
#: The partition column of stored rows. Columns of documents that are named so, with underscores or not, are stored with one underscore more.
SHARD = "millrace_shard"
#: Files that one job merges, and tasks that store arrivals, at most.
BATCH, WRITERS = 256, 100_000
MANIFEST = "shard long, name string, tier int, rows long, bytes long, runs int"


def tier(size):
    """The tier of a size in bytes: 0 below 1 MiB, one more for each FACTOR."""
    return F.when(size < 1 << 20, 0).otherwise(F.floor((F.length(F.bin(F.floor(size / (1 << 20)).cast("long"))) - 1) / (FACTOR.bit_length() - 1)).cast("int") + 1)


def stored(docs: DataFrame) -> DataFrame:
    """docs by the names that their columns have in the store."""
    return docs.toDF(*(c + "_" if c.lower().rstrip("_") == SHARD else c for c in docs.columns))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{root}/versions"))

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max([0, *(int(s.getPath().getName()[1:]) for s in self._fs.listStatus(self._path(f"{self.root}/versions")))])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards: shard, name (of its folder), tier, rows, bytes, runs (arrivals it holds)."""
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/versions/v{v:08d}") if v else self.spark.createDataFrame([], MANIFEST)

    def commit(self, shards: DataFrame, version: int) -> None:
        """Make shards the manifest of a version that must not exist."""
        aside, place = f"{self.root}/aside-{uuid.uuid4().hex}", f"{self.root}/versions/v{version:08d}"
        shards.coalesce(1).write.parquet(aside)
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(aside), self._path(place), options)

    def rows(self, version: int | None = None) -> DataFrame:
        """All documents of a version, with the column SHARD (lengthened if they have one), the name of theirs; None without shards."""
        paths = [f"{self.root}/data/{SHARD}={r.name}" for r in self.manifest(version).select("name").collect()]
        if not paths:
            return None
        found = self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths)
        own = {c: c[:-1] for c in found.columns if c != SHARD and c.lower().rstrip("_") == SHARD}
        name = fresh(SHARD, [own.get(c, c) for c in found.columns if c != SHARD])
        return found.select(*(F.col(c).alias(own.get(c, c)) for c in found.columns if c != SHARD), F.col(SHARD).cast("string").alias(name))

    def append(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", arrival: int = ARRIVAL) -> int:
        """Store docs as new shards of about arrival bytes. Returns the version."""
        version = self.version()
        before = self.rows(version)
        if before is not None and sorted(before.columns[:-1]) != sorted(docs.columns):
            raise ValueError(f"the store has the columns {before.columns[:-1]}")
        first = self.manifest(version).agg(F.coalesce(F.max("shard"), F.lit(-1)) + 1).first()[0]
        size = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
        total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        n = max(1, -(-total // arrival))
        which = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % n + first
        token = uuid.uuid4().hex
        stored(docs).withColumn(SHARD, F.concat(which.cast("string"), F.lit(f"-{token}"))).repartition(min(n, WRITERS), SHARD).write.mode("append").option("compression", "zstd").partitionBy(SHARD).parquet(f"{self.root}/data")
        sizes = docs.select(which.alias("shard"), size.alias("size")).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        new = sizes.select("shard", F.concat(F.col("shard").cast("string"), F.lit(f"-{token}")).alias("name"), tier(F.col("bytes")).alias("tier"), "rows", "bytes", F.lit(1).alias("runs"))
        self.commit(self.manifest(version).unionByName(new), version + 1)
        return version + 1

    def plan(self, shards: DataFrame, target: int = TARGET) -> DataFrame:
        """shard, into: the shards that are merged, and the smallest of those that become one file. Runs of a tier follow their number; a file takes those that begin within the same target bytes."""
        w = Window.partitionBy("tier").orderBy("shard")
        small = shards.where(F.col("bytes") < target).withColumn("before", F.sum("bytes").over(w) - F.col("bytes"))
        file = Window.partitionBy("tier", F.floor(F.col("before") / target))
        return small.select("shard", "name", "rows", "bytes", "runs", F.min("shard").over(file).alias("lead"), F.count("*").over(file).alias("members")).where("members > 1")

    def compact(self, target: int = TARGET) -> int:
        """Merge similar runs into files of about target bytes. Returns the version, a new one if anything was merged."""
        version = self.version()
        shards = self.manifest(version)
        token, aside = uuid.uuid4().hex, f"{self.root}/aside-{uuid.uuid4().hex}"
        first = shards.agg(F.coalesce(F.max("shard"), F.lit(-1)) + 1).first()[0]
        merges = self.plan(shards, target).groupBy("lead").agg(F.sort_array(F.collect_list("name")).alias("names"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("runs").cast("int").alias("runs"))
        numbered = merges.withColumn("shard", F.row_number().over(Window.orderBy("lead")) - 1 + F.lit(first))
        numbered.withColumn("name", F.concat(F.col("shard").cast("string"), F.lit(f"-{token}"))).write.parquet(aside)
        merges, schema = self.spark.read.parquet(aside), None
        work = self.spark.newSession()  # whose unions keep the tasks of their parts
        work.conf.set("spark.sql.unionOutputPartitioning", "false")
        for batch in batched(merges.select("name", "names").orderBy("name").toLocalIterator(), BATCH):
            paths = [[f"{self.root}/data/{SHARD}={n}" for n in m.names] for m in batch]
            schema = schema or self.spark.read.parquet(paths[0][0]).schema
            files = [work.read.schema(schema).parquet(*p).coalesce(1).withColumn(SHARD, F.lit(m.name)) for m, p in zip(batch, paths)]
            reduce(DataFrame.union, files).write.mode("append").option("compression", "zstd").partitionBy(SHARD).parquet(f"{self.root}/data")
        if schema is None:
            return version
        kept = shards.join(merges.select(F.explode("names").alias("name")), "name", "left_anti").select(*shards.columns)
        self.commit(kept.unionByName(merges.select("shard", "name", tier(F.col("bytes")).alias("tier"), "rows", "bytes", "runs")), version + 1)
        return version + 1


def op10_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored, compacted and read back through the manifest: doc_id, n_bytes, shard, tier, shard_rows, shard_bytes, runs, version."""
    store = Store(spark, new_path(spark, "op10-store"))
    store.append(read(spark, sf_dir, "documents"))
    version = store.compact()
    live = store.manifest(version).withColumnsRenamed({"rows": "shard_rows", "bytes": "shard_bytes"})
    rows = store.rows(version)
    if rows is None:
        rows = read(spark, sf_dir, "documents").withColumn(SHARD, F.lit(""))
    rows = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col(SHARD).cast("string").alias("name"))
    return rows.join(live, "name").drop("name").withColumn("version", F.lit(version).cast("long"))


ORACLE = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
t AS (SELECT greatest(ceil(sum(n_bytes) / {ARRIVAL})::BIGINT, 1) AS n FROM d),
a AS (SELECT doc_id, n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % n AS run FROM d, t),
r AS (SELECT run, count(*) AS rows, sum(n_bytes)::BIGINT AS bytes, CASE WHEN sum(n_bytes) < 1048576 THEN 0 ELSE floor(floor(log2(floor(sum(n_bytes) / 1048576))) / 2)::INT + 1 END AS tier FROM a GROUP BY run),
c AS (SELECT *, sum(bytes) OVER (PARTITION BY tier ORDER BY run) - bytes AS before FROM r WHERE bytes < {TARGET}),
f AS (SELECT *, min(run) OVER g AS lead, count(*) OVER g AS members FROM c WINDOW g AS (PARTITION BY tier, floor(before / {TARGET}))),
m AS (SELECT lead, sum(rows)::BIGINT AS rows, sum(bytes)::BIGINT AS bytes, sum(1)::INT AS runs, (SELECT max(run) + 1 FROM r) + row_number() OVER (ORDER BY lead) - 1 AS shard FROM f WHERE members > 1 GROUP BY lead),
o AS (SELECT r.run, coalesce(m.shard, r.run) AS shard, coalesce(m.rows, r.rows) AS rows, coalesce(m.bytes, r.bytes) AS bytes, coalesce(m.runs, 1) AS runs
      FROM r LEFT JOIN (SELECT run, lead FROM f WHERE members > 1) x USING (run) LEFT JOIN m USING (lead))
SELECT doc_id, n_bytes, shard::BIGINT AS shard, CASE WHEN bytes < 1048576 THEN 0 ELSE floor(floor(log2(floor(bytes / 1048576))) / 2)::INT + 1 END AS tier,
       rows::BIGINT AS shard_rows, bytes::BIGINT AS shard_bytes, runs::INT AS runs, (SELECT CASE WHEN count(*) > 0 THEN 2 ELSE 1 END FROM m)::BIGINT AS version
FROM a JOIN o USING (run)
"""
