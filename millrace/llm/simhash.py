"""SimHash near-duplicates, found with a table of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to PIVOTS reference fingerprints. By the triangle inequality two fingerprints
within RADIUS differ by at most RADIUS in every coordinate of that table, so a pair whose largest coordinate difference exceeds it is
discarded and only survivors are compared.

Which pairs meet at all is decided by references that differ within one 16-bit block: the distances to these give the block itself, and of
four blocks at least two must be equal within a radius of 2. So every fingerprint goes under six keys of two blocks. A key with more than
CROWD fingerprints is divided once more, by eight 4-bit parts of its free bits of which six must agree; such a key leaves 8 bits free and
thus holds at most 256 different fingerprints, whatever the corpus. No pair within the radius is lost and no group is paired in full.

Copies share a fingerprint and are reduced to it (with their smallest id) before any pair is made. Links join into components.

Defined results: a null or blank text has no words and fingerprint 0, linked like any other; a text of fewer words than a shingle is one
shingle. Null ids are never the smallest id unless all of a component are null. Repeated rows give a row each. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import drop_rows, materialize, read, ship, spread, with_row_key
from millrace.llm.graph import components, named_components

SHINGLE, SEED, RADIUS = 3, 42, 2
PIVOTS, CROWD, RUNS = 16, 64, 64


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    ws = data.lower().split()  # of bytes: A-Z only, and the ASCII white space that the words exclude
    if not ws:
        return 0
    norm = b" ".join(ws)
    if len(ws) <= shingle:
        hashes = [xxh64_intdigest(norm, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = [0, *(ends[: len(ws) - shingle] + 1).tolist()]
        hashes = [xxh64_intdigest(norm[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        h = np.array(hashes[i : i + 65536], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """rid (row, by default a running number), id, fp of every row."""

    def of(batches):
        import pyarrow as pa

        for b in batches:
            fps = pa.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in b.column("t")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), fps], ["rid", "id", "fp"])

    ship(docs.sparkSession)
    rows = docs.select((F.monotonically_increasing_id() if row is None else row).alias("rid"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return spread(rows).mapInArrow(of, T.StructType([*rows.schema.fields[:2], T.StructField("fp", T.LongType())]))


def references() -> list[int]:
    """PIVOTS fixed reference fingerprints, as signed integers."""
    import xxhash

    return [x - (1 << 64) if (x := xxhash.xxh64_intdigest(f"pivot {i}")) >> 63 else x for i in range(PIVOTS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_masks() -> tuple[list[int], list[list[int]]]:
    """The six masks of two equal blocks, and for each the 28 masks that also keep six of eight parts of the other bits."""
    block = [0xFFFF << (16 * i) for i in range(4)]
    first, second = [], []
    for i, j in combinations(range(4), 2):
        first.append(signed(block[i] | block[j]))
        free = [0xF << (16 * k + 4 * q) for k in range(4) if k not in (i, j) for q in range(4)]
        second.append([signed(block[i] | block[j] | sum(free) - free[x] - free[y]) for x, y in combinations(range(8), 2)])
    return first, second


def close_pairs(keyed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """a, b: fingerprints under one key whose pivot coordinates differ by at most radius, verified."""
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = F.greatest(*(F.abs(F.col("a.pivots")[i].cast("int") - F.col("b.pivots")[i].cast("int")) for i in range(PIVOTS)))
    near = (F.col("a.fp") < F.col("b.fp")) & (apart <= radius) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, [*on, near]).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: the pairs of different fingerprints of fps (one column fp, distinct) within radius (at most 2)."""
    if radius > 2:
        raise ValueError("the keys hold for a radius of at most 2")
    first, second = key_masks()
    pivots = F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("byte") for r in references()))
    masked = lambda mask: F.col("fp").bitwiseAND(F.lit(mask))
    under = fps.select("fp", pivots.alias("pivots"), F.posexplode(F.array(*map(masked, first))).alias("t", "key"))
    under = materialize(under, "op2-keys")
    crowded = materialize(under.groupBy("t", "key").count().where(F.col("count") > CROWD).select("t", "key"), "op2-crowded")
    if not crowded.limit(1).count():
        return close_pairs(under, ["t", "key"], radius).distinct()
    rest = under.join(crowded, ["t", "key"], "left_anti")
    sub: Column = F.array(*map(masked, second[0]))
    for i in range(1, len(second)):
        sub = F.when(F.col("t") == i, F.array(*map(masked, second[i]))).otherwise(sub)
    finer = under.join(crowded, ["t", "key"], "left_semi").select("fp", "pivots", "t", F.posexplode(sub).alias("u", "key"))
    return close_pairs(rest, ["t", "key"], radius).unionByName(close_pairs(finer, ["t", "u", "key"], radius)).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, row: Column | None = None) -> DataFrame:
    """One row per row of docs: rid, id, fp, component_id (the smallest id of the component)."""
    rows = materialize(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, row=row).withColumn("run", F.pmod(F.xxhash64("rid"), F.lit(RUNS)).cast("int")), "op2-fingerprints")
    runs = rows.groupBy("fp", "run").agg(F.min("id").alias("least"))
    classes = materialize(runs.groupBy("fp").agg(F.min("least").alias("least")), "op2-classes")
    roots = components(links(classes.select("fp"), radius))
    named = runs.select("fp", "run").join(named_components(classes.withColumnRenamed("fp", "node"), roots).withColumnRenamed("node", "fp"), "fp")
    return rows.join(named, ["fp", "run"]).select("rid", "id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of near_duplicates() over documents."""
    return near_duplicates(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns kept: of every component the row with the smallest id, of repeated ids the first by place."""
    keyed, row = with_row_key(docs)
    found = materialize(near_duplicates(keyed, row=F.col(row)), "op2-components")
    first = F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")
    runs = found.groupBy("component_id", F.pmod(F.xxhash64("rid"), F.lit(RUNS)).alias("run")).agg(first)
    stays = runs.groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    return drop_rows(keyed, row, found.join(stays, "rid", "left_anti").select("rid"))
