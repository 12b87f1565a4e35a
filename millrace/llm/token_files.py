"""Token ids in binary shards with a minimal perfect hash index from document keys to places.

Documents are ordered by (doc_id, text) with one range exchange; each task encodes its range and appends raw ids to one shard file:
unsigned little-endian integers of 2 bytes, or 4 where the vocabulary needs it. Files get names that no other attempt uses; which of them
are the shards is told by the committed table of entries, so that a task which is run again or lost leaves nothing but an unused file.

A document's key is its id and its number among rows of the same id, as two 64-bit hashes. Keys are divided by hash among index files of
about KEYS_PER_INDEX keys, each a minimal perfect hash with a stored fingerprint of 64 bits and shard, offset and count; two documents of
equal hashes would stop the build. Keys that are looked up are dealt to the index files, of which each task reads one.

Defined results: a null or empty text has the end id alone. Null ids come first and rows of one id follow in order of their texts, each a
document of its own; rows of one id are spread over tasks by the first PREFIX characters of their texts. Other columns are ignored. An empty
table makes no files and no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import cores_for, materialize, new_path, read, ship
from millrace.llm._files import make_dir, random_access, write_to
from millrace.llm.byte_bpe import encoder, in_chunks, vocabulary

END_ID = 2
KEYS_PER_INDEX = 32768
PREFIX = 64


def named(id_: str, nth: str) -> Column:
    return F.concat(F.coalesce(F.col(id_).cast("string"), F.lit("null")), F.lit("/"), F.col(nth).cast("string"))


def numbered(entries: DataFrame) -> DataFrame:
    """entries with nth counted over all shards, of entries where it is counted in each; only ids that go on from shard to shard are touched."""
    ends = entries.groupBy("shard").agg(F.array_distinct(F.array(F.min_by("id", "offset"), F.max_by("id", "offset"))).alias("ids"))
    across = ends.select(F.explode("ids").alias("id")).groupBy("id").count().where("count > 1").select(F.col("id").alias("across"))
    across = materialize(across, "op3-across")
    if not across.limit(1).count():
        return entries
    counts = entries.join(across, F.col("id").eqNullSafe(F.col("across"))).groupBy("id", "shard").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select(F.col("id").alias("across"), F.col("shard").alias("in_shard"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")), "op3-bases")
    return entries.join(bases, F.col("id").eqNullSafe(F.col("across")) & (F.col("shard") == F.col("in_shard")), "left").withColumn("nth", (F.col("nth") + F.coalesce("before", F.lit(0))).cast("int")).select(*entries.columns)


def write_shards(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encode docs into shard files in folder. Returns the entries, written: id, nth (of rows of one id, from 0), key, shard (in order of ids), file, offset (in ids), n."""
    make_dir(folder)

    path = vocab or vocabulary()

    def of(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, file = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}.ids"
        out, at, last, nth = None, 0, (), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = b.column("id").to_pylist()
            texts = b.column("t")
            for some in in_chunks([len(x.as_buffer()) if x.is_valid else 0 for x in texts]):
                rows = []
                for i, raw in zip(some, encoder(path).encode(texts.slice(some.start, len(some)).to_pylist())):
                    a = np.frombuffer(raw + end, "<u4")
                    if width == 2 and a.max() > 0xFFFF:
                        raise ValueError("this vocabulary needs 4 bytes an id")
                    out = out or write_to(f"{folder}/{file}")
                    out.write(a.astype(f"<u{width}").tobytes())
                    nth = nth + 1 if (ids[i],) == last else 0
                    last = (ids[i],)
                    rows.append((ids[i], nth, shard, file, at, len(a)))
                    at += len(a)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["id", "nth", "shard", "file", "offset", "n"])
        if out:
            out.close()

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    by = ["id", F.substring("t", 1, PREFIX)]
    n = cores_for(rows)
    ordered = (rows.repartitionByRange(n, *by) if n else rows.repartitionByRange(*by)).sortWithinPartitions("id", "t")
    written = materialize(ordered.mapInArrow(of, "id long, nth int, shard int, file string, offset long, n long"), "op3-places")
    return materialize(numbered(written).withColumn("key", F.xxhash64(named("id", "nth"))), "op3-entries")


def second_hash() -> Column:
    """The second hash of a key, of another seed than the first."""
    return F.xxhash64(F.lit(1), named("id", "nth"))


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Index files over the entries. Returns, written: part, parts, file."""
    parts = max(1, -(-entries.count() // KEYS_PER_INDEX))

    def of(key, table):
        import pyarrow as pa

        from millrace.llm.perfect_hash import build

        file = f"index-{uuid.uuid4().hex}.mph"
        with write_to(f"{folder}/{file}") as out:
            out.write(build(*(table.column(c).to_numpy() for c in ("key", "shard", "offset", "n", "check"))))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "file": [file]})

    mine = entries.select("key", second_hash().alias("check"), "shard", "offset", "n", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    index = materialize(mine.groupBy("part").applyInArrow(of, "part int, file string"), "op3-index")
    return index.withColumn("parts", F.lit(parts))


def lookup(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """For each row of keys (id, nth, key) what its index file has: shard, offset, n, and found."""
    parts = index.select("parts").first()
    n_parts = parts.parts if parts else 1

    def of(key, table):
        import numpy as np
        import pyarrow as pa

        from millrace.llm.perfect_hash import RECORD, Index

        if (file := table.column("file")[0].as_py()) is None:
            found, ok = np.zeros(len(table), RECORD), np.zeros(len(table), bool)
        else:
            with random_access(f"{folder}/{file}") as f:
                found, ok = Index(f.read()).find(table.column("key").to_numpy(), table.column("check").to_numpy())
        return pa.table({"id": table.column("id"), "nth": table.column("nth"), "shard": pa.array(found["shard"].astype("int32")), "offset": pa.array(found["offset"].astype("int64")), "n": pa.array(found["n"].astype("int64")), "found": pa.array(ok)})

    asked = keys.select("id", "nth", "key", second_hash().alias("check"), F.pmod(F.xxhash64("key"), F.lit(n_parts)).cast("int").alias("part"))
    return asked.join(index.select("part", "file"), "part", "left").groupBy("part").applyInArrow(of, "id long, nth int, shard int, offset long, n long, found boolean")


def read_ids(places: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """The documents at places (id, nth, shard, file, offset, n): id, nth, shard, offset, n and ids_crc32, from the shard files."""

    def of(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        name, f = None, None
        for b in batches:
            crc = []
            for file, offset, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "n"))):
                if file != name:
                    name, f = file, random_access(f"{folder}/{file}")
                f.seek(offset * width)
                raw = f.read(n * width)
                if len(raw) != n * width:
                    raise ValueError(f"{file} ends early")
                crc.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "nth", "shard", "offset", "n")), pa.array(crc, pa.int64())], ["id", "nth", "shard", "offset", "n", "ids_crc32"])

    at = places.select("id", "nth", "shard", "file", "offset", "n").repartition("file").sortWithinPartitions("file", "offset")
    return at.mapInArrow(of, "id long, nth int, shard int, offset long, n long, ids_crc32 long")


def shard_bases(entries: DataFrame) -> DataFrame:
    """shard, file, base: the ids of all shards before it. One row a shard."""
    totals = entries.groupBy("shard", "file").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def round_trip(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs, then fetch every document by its key through the index: doc_id, start, n_tokens, ids_crc32."""
    entries = write_shards(docs, folder, doc_id=doc_id, text=text, vocab=vocab, end_id=end_id)
    index = write_index(entries, folder)
    places = lookup(entries, index, folder)
    bases = shard_bases(entries)
    sure = places.withColumn("n", F.when(F.col("found"), F.col("n")).otherwise(F.raise_error(F.format_string("document %s, number %s, is not in the index", "id", "nth"))))
    got = read_ids(sure.join(bases.select("shard", "file"), "shard"), folder)
    return got.join(bases.select("shard", "base"), "shard").select(F.col("id").alias(doc_id), (F.col("base") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of documents written and read back."""
    return round_trip(read(spark, sf_dir, "documents"), new_path(spark, "op3-files"))
